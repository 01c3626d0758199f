"""Delivery: batches, outcomes, headers, backlogs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventweir.operators import delivery as ops
from eventweir.operators.joins import small_table
from eventweir.operators.routing import batch_by_flow
from eventweir.plans.ingest import delivery_batches
from eventweir.sinks.deliver import deliver
from workloads import fixtures as fx
from workloads.registry import query
from workloads.routing import FLOWS_SQL, flows

KEPT_SQL = f"""WITH t AS (SELECT *, coalesce(status_code BETWEEN 200 AND 299, false) AS ok,
    coalesce(status_code BETWEEN 200 AND 299 OR status_code BETWEEN 400 AND 499, false) AS terminal FROM ({fx.ATTEMPTS}) x),
  f AS (SELECT batch_id, min(attempt_no) FILTER (WHERE terminal) AS last_no, max(attempt_no) AS max_no FROM t GROUP BY batch_id),
  k AS (SELECT t.*, coalesce(f.last_no, f.max_no) AS end_no FROM t JOIN f USING (batch_id) WHERE t.attempt_no <= coalesce(f.last_no, f.max_no))"""

OUTCOME_SQL = f"""{KEPT_SQL} SELECT event_type, flow_id, batch_id, CASE WHEN ok THEN 'delivered' WHEN terminal THEN 'rejected' ELSE 'lost' END AS status,
    CASE WHEN terminal THEN uri END AS uri, CAST(attempt_no AS BIGINT) AS attempts, n_events FROM k WHERE attempt_no = end_no"""

FLOW = ["event_type", "flow_id"]


def attempts(t):
    return t.sql(fx.ATTEMPTS)


def outcomes(t):
    return ops.delivery_outcome(attempts(t), FLOW)


@query(
    "batch_by_flow",
    f"""WITH n AS (SELECT type, uuid, row_number() OVER (PARTITION BY type ORDER BY seq) - 1 AS rn FROM ({fx.ENVELOPE}) x)
    SELECT n.uuid, n.type, f.flow_id, CAST(rn // 100 AS BIGINT) AS batch_id, CAST(rn % 100 AS BIGINT) AS pos
    FROM n JOIN ({FLOWS_SQL}) f ON n.type = f.event_type""",
)
def _(t):
    events = fx.envelope(t).select("type", "uuid", "seq")
    return batch_by_flow(events, flows(t), "seq", 100).select("uuid", "type", "flow_id", "batch_id", "pos")


@query("delivery_outcome", OUTCOME_SQL)
def _(t):
    return outcomes(t).withColumn("attempts", F.col("attempts").cast("bigint"))


@query(
    "dropped_header",
    f"""{KEPT_SQL},
    s AS (SELECT flow_id, batch_id, attempt_no, 1 AS kind, ok, CASE WHEN attempt_no = end_no AND NOT ok THEN n_events ELSE 0 END AS contrib FROM k
      UNION ALL SELECT flow_id, batch_id, 0, 0, false, n_dropped FROM ({fx.DROPS}) d),
    c AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY batch_id, kind, attempt_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM s),
    r AS (SELECT *, coalesce(sum(contrib) OVER (PARTITION BY flow_id, island ORDER BY batch_id, kind, attempt_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM c)
    SELECT flow_id, batch_id, attempt_no, CAST(dropped AS BIGINT) AS dropped_messages FROM r WHERE kind = 1""",
)
def _(t):
    found = ops.dropped_header(attempts(t), t.sql(fx.DROPS))
    return found.select("flow_id", "batch_id", "attempt_no", "dropped_messages")


@query(
    "first_batch_flag",
    f"""{KEPT_SQL},
    s AS (SELECT flow_id, uri, batch_id, attempt_no, 1 AS kind, ok FROM k
      UNION ALL SELECT DISTINCT flow_id, uri, batch_id, 0, 0, false FROM ({fx.TAP_EPOCHS}) e),
    c AS (SELECT *, sum(1 - kind) OVER (PARTITION BY flow_id, uri ORDER BY batch_id, kind, attempt_no) AS epoch FROM s),
    r AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id, uri, epoch ORDER BY batch_id, kind, attempt_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c)
    SELECT flow_id, uri, batch_id, attempt_no, seen = 0 AS first_batch FROM r WHERE kind = 1""",
)
def _(t):
    found = ops.first_batch_flag(attempts(t), t.sql(fx.TAP_EPOCHS))
    return found.select("flow_id", "uri", "batch_id", "attempt_no", "first_batch")


@query(
    "outbound_counts",
    f"""SELECT event_type, flow_id, uri, status, CAST(sum(n_events) AS BIGINT) AS n_events FROM ({OUTCOME_SQL}) o GROUP BY 1, 2, 3, 4
    UNION ALL SELECT event_type, flow_id, NULL, 'dropped', CAST(sum(n_dropped) AS BIGINT) FROM ({fx.DROPS}) d GROUP BY 1, 2 HAVING sum(n_dropped) > 0""",
)
def _(t):
    return ops.outbound_counts(outcomes(t), t.sql(fx.DROPS))


BACKLOG_SQL = f"""WITH RECURSIVE a AS (SELECT flow_id, tick, arrivals, row_number() OVER (PARTITION BY flow_id ORDER BY tick) AS rn FROM ({fx.ARRIVALS}) x),
    r AS (SELECT flow_id, tick, rn, least(arrivals, CAP) AS accepted, arrivals - least(arrivals, CAP) AS dropped,
         least(MAXB, least(arrivals, CAP)) AS sent, least(arrivals, CAP) - least(MAXB, least(arrivals, CAP)) AS backlog
      FROM a WHERE rn = 1
      UNION ALL
      SELECT a.flow_id, a.tick, a.rn, least(a.arrivals, CAP - r.backlog), a.arrivals - least(a.arrivals, CAP - r.backlog),
         least(MAXB, r.backlog + least(a.arrivals, CAP - r.backlog)),
         r.backlog + least(a.arrivals, CAP - r.backlog) - least(MAXB, r.backlog + least(a.arrivals, CAP - r.backlog))
      FROM r JOIN a ON a.flow_id = r.flow_id AND a.rn = r.rn + 1)
    SELECT flow_id, CAST(tick AS BIGINT) AS tick, accepted, dropped AS overflow_dropped, sent, backlog FROM r""".replace(
    "CAP", "100"
).replace("MAXB", "60")


def backlog(t):
    return ops.bounded_backlog(t.sql(fx.ARRIVALS), capacity=100, max_batch=60)


@query("bounded_backlog", BACKLOG_SQL)
def _(t):
    return backlog(t).drop("requeue_dropped")


QUEUE_LOG = f"""SELECT flow_id, tick AS read_no,
    CAST(sum(arrivals) OVER (PARTITION BY flow_id ORDER BY tick) AS BIGINT) AS enqueued,
    CAST(sum(arrivals) OVER (PARTITION BY flow_id ORDER BY tick) - arrivals AS BIGINT) AS dequeued,
    CAST(floor(sum(arrivals) OVER (PARTITION BY flow_id ORDER BY tick) / 10) AS BIGINT) AS dropped FROM ({fx.ARRIVALS}) x"""


@query(
    "backlog_metrics",
    f"""SELECT flow_id, read_no, enqueued - coalesce(lag(enqueued) OVER w, 0) AS enqueued, dequeued - coalesce(lag(dequeued) OVER w, 0) AS dequeued,
    dropped - coalesce(lag(dropped) OVER w, 0) AS dropped, enqueued - dequeued AS size FROM ({QUEUE_LOG}) q WINDOW w AS (PARTITION BY flow_id ORDER BY read_no)""",
)
def _(t):
    return ops.backlog_metrics(t.sql(QUEUE_LOG))


@query(
    "deliver",
    f"""SELECT f.event_type, f.flow_id, 'delivered' AS status, CAST(count(*) AS BIGINT) AS n_events
    FROM ({fx.ENVELOPE}) x JOIN ({FLOWS_SQL}) f ON x.type = f.event_type GROUP BY 1, 2""",
)
def _(t):
    """Every consumer takes every batch."""
    table = small_table(flows(t), "flows")
    batches = delivery_batches(fx.envelope(t), table, "seq", 100)
    sent = deliver(batches, table, lambda uri, headers, lines: 202, retry_delay=0)
    counts = ops.outbound_counts(ops.delivery_outcome(sent, FLOW))
    return counts.groupBy("event_type", "flow_id", "status").agg(F.sum("n_events").alias("n_events"))


FAILOVER_SQL = f"""WITH n AS (SELECT type, seq, row_number() OVER (PARTITION BY type ORDER BY seq) - 1 AS rn FROM ({fx.ENVELOPE}) x),
    b AS (SELECT type, CAST(rn // 100 AS BIGINT) AS batch_id, min(seq) AS e, count(*) AS n_events FROM n GROUP BY 1, 2),
    s AS (SELECT f.event_type, f.flow_id, batch_id, n_events, e, qos_enabled, len(destinations) AS taps,
                 concat('http://tap', e % 12, '.example:8080') AS up FROM b JOIN ({FLOWS_SQL}) f ON b.type = f.event_type),
    h AS (SELECT *, list_contains((SELECT any_value(destinations) FROM ({FLOWS_SQL}) g
                                   WHERE g.event_type = s.event_type AND g.flow_id = s.flow_id), up) AS hit FROM s)
    SELECT event_type, flow_id, batch_id, n_events, CASE WHEN NOT hit THEN 'lost' WHEN e % 5 = 0 THEN 'rejected' ELSE 'delivered' END AS status,
           CASE WHEN hit THEN up END AS uri, CASE WHEN NOT hit THEN CAST(taps * CASE WHEN qos_enabled THEN 3 ELSE 1 END AS BIGINT) END AS tries FROM h"""


@query("deliver_failover", FAILOVER_SQL)
def _(t):
    """Of twelve taps only the one that a batch's first event names answers; retries change nothing."""

    def transport(uri, headers, lines):
        event = int(json.loads(lines[0])["uuid"])
        if uri != f"http://tap{event % 12}.example:8080":
            return 503
        return 404 if event % 5 == 0 else 202

    table = small_table(flows(t), "flows")
    batches = delivery_batches(fx.envelope(t), table, "seq", 100)
    sent = deliver(batches, table, transport, retry_count=2, retry_delay=0)
    found = ops.delivery_outcome(sent, FLOW)
    tries = F.when(F.col("status") == "lost", F.col("attempts").cast("bigint"))
    return found.select(*FLOW, "batch_id", F.col("n_events").cast("bigint"), "status", "uri", tries.alias("tries"))
