"""Ingest: envelopes, accept lists, buckets, counts, spooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventweir.functions.envelope import (
    accept_types,
    event_line,
    event_partition,
    select_properties,
    validate_envelope,
)
from eventweir.operators import ingest as ops
from eventweir.operators.files import file_partition, file_verdicts, retry_ledger, upload_stats
from eventweir.plans.ingest import hourly_counts, hourly_partition_counts
from eventweir.session import scratch_path
from eventweir.sinks.spool import read_spool_lines, spool_lines, write_spool
from eventweir.sources.events import explode_batches, read_event_log, to_envelope
from workloads import fixtures as fx
from workloads.registry import query

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(column: str = "timestamp"):
    return F.date_format(column, TS).alias("ts_text")


def k_value():
    return F.get_json_object("data", "$.k").alias("k")


@query(
    "hourly_partition_counts",
    f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n_events
    FROM events WHERE event_type IN {fx.ACCEPTED_SQL} GROUP BY 1, 2, 3""",
)
def _(t):
    return hourly_partition_counts(fx.envelope(t), fx.ACCEPTED)


@query(
    "explode_batches",
    f"""SELECT CAST(floor(seq / 50) AS BIGINT) AS batch_id, seq % 50 AS seq, type, uuid, host, {TS_SQL} AS ts_text,
    json_extract_string(data, '$.k') AS k FROM ({fx.ENVELOPE}) x""",
)
def _(t):
    return explode_batches(bodies(t)).select("batch_id", F.col("seq").cast("bigint"), "type", "uuid", "host", ts_text(), k_value())


def bodies(t, text=fx.ENVELOPE):
    """Request bodies: JSON arrays of up to 50 events."""
    lines = fx.envelope(t, text).select(F.floor(F.col("seq") / 50).alias("batch_id"), "seq", event_line().alias("line"))
    batches = lines.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("e"))
    return batches.select("batch_id", F.concat(F.lit("["), F.array_join("e.line", ","), F.lit("]")).alias("body"))


@query(
    "read_event_log",
    f"""SELECT type, uuid, host, {TS_SQL} AS ts_text, json_extract_string(data, '$.k') AS k FROM ({fx.ENVELOPE}) x""",
)
def _(t):
    root = scratch_path(t.spark, "event-log")
    write_spool(fx.envelope(t), root)
    return read_event_log(t.spark, root).select("type", "uuid", "host", ts_text(), k_value())


@query(
    "spool_roundtrip",
    f"""SELECT type AS event_type, strftime(event_ts, '%Y-%m-%d') AS date, strftime(event_ts, '%H') AS hour, uuid
    FROM ({fx.ENVELOPE}) x""",
)
def _(t):
    root = scratch_path(t.spark, "spool")
    write_spool(fx.envelope(t), root, max_records=10_000)
    lines = read_spool_lines(t.spark, root)
    return lines.select("event_type", "date", "hour", F.get_json_object("value", "$.uuid").alias("uuid"))


@query(
    "to_envelope",
    """SELECT 'OrderPlaced' AS type, CAST(o_orderkey AS VARCHAR) AS uuid, concat('c', CAST(o_custkey AS VARCHAR)) AS host,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, o_orderstatus AS status, o_totalprice AS price FROM orders""",
)
def _(t):
    orders = t.sql("SELECT * FROM orders")
    host = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    events = to_envelope(orders, "OrderPlaced", F.col("o_orderdate"), F.col("o_orderkey"), host, ["o_orderstatus", "o_totalprice"])
    return events.select(
        "type",
        "uuid",
        "host",
        ts_text(),
        F.get_json_object("data", "$.o_orderstatus").alias("status"),
        F.get_json_object("data", "$.o_totalprice").cast("double").alias("price"),
    )


@query(
    "validate_envelope",
    f"""SELECT seq, concat_ws(';', CASE WHEN type IS NULL THEN 'type is missing' END,
      CASE WHEN NOT regexp_full_match(type, '[A-Za-z][A-Za-z0-9]*') THEN 'type must be alphanumeric' END,
      CASE WHEN uuid IS NULL THEN 'uuid is missing' END, CASE WHEN host IS NULL THEN 'host is missing' END,
      CASE WHEN event_ts IS NULL THEN 'timestamp is missing' END,
      CASE WHEN data IS NULL THEN 'data is missing' END) AS violations
    FROM ({fx.FAULTY}) x""",
)
def _(t):
    found = validate_envelope(fx.envelope(t, fx.FAULTY))
    text = F.transform("violations", lambda v: F.concat_ws(" ", v["field"], v["message"]))
    return found.select("seq", F.array_join(text, ";").alias("violations"))


@query(
    "accept_types",
    f"""SELECT seq, type, CASE WHEN coalesce(type IN {fx.ACCEPTED_SQL}, false) THEN 'valid' ELSE 'unsupported' END AS status
    FROM ({fx.FAULTY}) x""",
)
def _(t):
    return accept_types(fx.envelope(t, fx.FAULTY), fx.ACCEPTED).select("seq", "type", "status")


@query(
    "event_partition",
    f"""SELECT uuid, strftime(event_ts, '%Y-%m-%d') AS date, strftime(event_ts, '%H') AS hour,
    concat(type, '/', strftime(event_ts, '%Y-%m-%d'), '/', strftime(event_ts, '%H')) AS path FROM ({fx.ENVELOPE}) x""",
)
def _(t):
    return event_partition(fx.envelope(t)).select("uuid", "date", "hour", "path")


WIDE = """
SELECT CAST(event_id AS VARCHAR(20)) AS uuid,
       concat('{"k":', CAST(user_id AS VARCHAR(20)), ',"kind":"', event_type, '","nested":{"id":', CAST(event_id AS VARCHAR(20)),
              ',"tags":["a","', event_type, '"]},"flag":true}') AS data
FROM events"""


@query(
    "select_properties",
    """SELECT CAST(event_id AS VARCHAR) AS uuid, concat('{"k":', user_id, ',"nested":{"id":', event_id, ',"tags":["a","', event_type, '"]}}') AS data
    FROM events""",
)
def _(t):
    return select_properties(t.sql(WIDE), {"data": ["k", "nested", "absent"], "other": ["x"]})


# The right side: some hosts differ, some events are missing, some come twice;
# key order and blanks of the payload differ everywhere, which is no difference.
LEFT = f"""SELECT type, uuid, host, event_ts, concat('{{"k":', CAST(seq AS VARCHAR(20)), ',"l":1}}') AS data FROM ({fx.ENVELOPE}) x"""
RIGHT_ONCE = """
SELECT event_type AS type, CAST(event_id AS VARCHAR(20)) AS uuid,
       CASE WHEN value > 40 THEN 'elsewhere' ELSE concat('host', CAST(user_id % 16 AS VARCHAR(20))) END AS host, ts AS event_ts,
       concat('{ "l": 1, "k": ', CAST(event_id AS VARCHAR(20)), ' }') AS data
FROM events WHERE value >= 5"""
RIGHT = f"{RIGHT_ONCE} UNION ALL {RIGHT_ONCE} AND value < 8"


@query(
    "diff_events",
    """WITH e AS (SELECT event_type AS type, CAST(event_id AS VARCHAR) AS uuid, concat('host', user_id % 16) AS host, ts, value FROM events),
    d AS (SELECT type, uuid, host, ts, 'left' AS side FROM e WHERE value < 5 OR value > 40
          UNION ALL SELECT type, uuid, CASE WHEN value > 40 THEN 'elsewhere' ELSE host END, ts, 'right' FROM e
          WHERE value > 40 OR (value >= 5 AND value < 8))
    SELECT type, uuid, host, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, concat('{"k":', uuid, ',"l":1}') AS data, side,
           CAST(1 AS BIGINT) AS n FROM d""",
)
def _(t):
    found = ops.diff_events(fx.envelope(t, LEFT), fx.envelope(t, RIGHT))
    return found.select("type", "uuid", "host", ts_text(), "data", "side", "n")


@query(
    "inbound_counts",
    f"""SELECT type AS event_type, CASE WHEN coalesce(type IN {fx.ACCEPTED_SQL}, false) THEN 'valid' ELSE 'unsupported' END AS status,
    'distribute' AS process_type, count(*) AS n_events FROM ({fx.FAULTY}) x GROUP BY 1, 2""",
)
def _(t):
    return ops.inbound_counts(fx.envelope(t, fx.FAULTY), fx.ACCEPTED, "distribute")


@query(
    "batch_verdicts",
    f"""WITH b AS (SELECT batch_id, CASE WHEN coalesce(type IN {fx.ACCEPTED_SQL}, false) THEN NULL ELSE coalesce(type, 'null') END AS bad
                   FROM ({fx.FAULTY}) x)
    SELECT batch_id, count(*) AS n_events, CASE WHEN count(bad) = 0 THEN 202 ELSE 400 END AS http_status,
    'Unsupported event type(s): ' || string_agg(DISTINCT bad, ', ' ORDER BY bad) AS message FROM b GROUP BY 1""",
)
def _(t):
    return ops.batch_verdicts(fx.envelope(t, fx.FAULTY), fx.ACCEPTED)


@query(
    "spool_counts",
    f"""SELECT type AS event_type, count(*) AS received, CAST(0 AS BIGINT) AS lost FROM ({fx.ENVELOPE}) x
    WHERE event_ts > TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1""",
)
def _(t):
    return ops.spool_counts(fx.envelope(t), F.lit("2024-01-10 12:00:00").cast("timestamp"))


@query(
    "fan_out",
    f"""SELECT uuid, sink FROM ({fx.ENVELOPE}) x, (VALUES ('write', 'spool'), ('write', 'tap'), ('distribute', 'tap')) s(process_type, sink)
    WHERE s.process_type = CASE WHEN host = 'host0' THEN 'distribute' ELSE 'write' END""",
)
def _(t):
    forwarded = F.when(F.col("host") == "host0", "distribute").otherwise("write")
    return ops.fan_out(fx.envelope(t), forwarded).select("uuid", "sink")


@query(
    "records_per_file",
    f"""WITH l AS (SELECT type AS event_type, octet_length(encode(concat('{{"type":"', type, '","uuid":"', uuid, '","host":"', host, '","timestamp":"',
      strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '","data":', data, '}}'))) + 1 AS n FROM ({fx.ENVELOPE}) x)
    SELECT event_type, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes,
    CAST(ceil(CAST(5242880 * count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS records_per_file FROM l GROUP BY 1""",
)
def _(t):
    return ops.records_per_file(spool_lines(fx.envelope(t)), 5 * 1024 * 1024, ["event_type"], "value")


LINE_SQL = """concat('{"type":"', type, '","uuid":"', uuid, '","host":"', host, '","timestamp":"',
      strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '","data":', data, '}')"""
MONTHLY = fx.ENVELOPE.replace("ts AS event_ts", "date_trunc('month', ts) AS event_ts")
ROLL_BYTES = 16384


@query(
    "roll_by_bytes",
    f"""WITH l AS (SELECT type AS event_type, strftime(event_ts, '%Y-%m-%d') AS date, seq, {LINE_SQL} AS line FROM ({MONTHLY}) x),
    s AS (SELECT *, octet_length(encode(line)) + 1 AS n FROM l),
    t AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY event_type, date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin,
                 CAST(sum(n) OVER (PARTITION BY event_type, date) AS BIGINT) AS total FROM s),
    f AS (SELECT *, (total + {ROLL_BYTES} - 1) // {ROLL_BYTES} AS files FROM t)
    SELECT event_type, date, lpad(CAST(begin // ((total + files - 1) // files) AS VARCHAR), 6, '0') AS file,
           CAST(1 AS BIGINT) AS n_files, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq
    FROM f GROUP BY ALL""",
)
def _(t):
    """What the files hold that a spool rolls at 16 kB, a bucket for each month."""
    root = scratch_path(t.spark, "spool")
    write_spool(fx.envelope(t, MONTHLY), root, target_bytes=ROLL_BYTES, position="seq")
    lines = t.spark.read.schema("value string, event_type string, date string, hour string, file string").text(root)
    lines = lines.withColumns({"path": F.col("_metadata.file_path"), "seq": F.get_json_object("value", "$.uuid").cast("bigint")})
    size = F.sum((F.octet_length("value") + 1).cast("bigint")).alias("bytes")
    files = lines.groupBy("event_type", "date", "file", "path").agg(F.count("*").alias("n"), size, F.min("seq").alias("a"), F.max("seq").alias("b"))
    return files.groupBy("event_type", "date", "file").agg(
        F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.sum("bytes").alias("bytes"), F.min("a").alias("first_seq"), F.max("b").alias("last_seq")
    )


@query(
    "hourly_counts",
    f"""SELECT type AS event_type, strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS n_events
    FROM ({fx.ENVELOPE}) x GROUP BY 1, 2""",
)
def _(t):
    return hourly_counts(fx.envelope(t))


@query(
    "upload_stats",
    f"""WITH l AS ({fx.FILE_LOG}),
    e AS (SELECT 'processed_files' AS metric, 'unknown' AS event_type, 'corrupt' AS status, NULL AS ms FROM l WHERE outcome = 'corrupt'
     UNION ALL SELECT 'processed_files', event_type, 'uploaded', NULL FROM l WHERE outcome = 'success'
     UNION ALL SELECT 'upload_attempts', event_type, outcome, NULL FROM l WHERE outcome <> 'corrupt'
     UNION ALL SELECT 'processed_time', event_type, NULL, duration_ms FROM l WHERE outcome <> 'corrupt')
    SELECT metric, event_type, status, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms FROM e GROUP BY 1, 2, 3""",
)
def _(t):
    return upload_stats(t.sql(fx.FILE_LOG))


@query(
    "retry_ledger",
    f"""WITH l AS ({fx.FILE_LOG}), s AS (SELECT file, arg_max(outcome, attempt) AS outcome, count(*) AS attempts,
      arg_max(finished_at, attempt) AS last_finished_at FROM l GROUP BY 1),
    d AS (SELECT file, CASE outcome WHEN 'success' THEN 'uploaded' WHEN 'corrupt' THEN 'failed' ELSE 'retry' END AS state, attempts, last_finished_at,
      CASE WHEN outcome = 'failure' THEN last_finished_at + 300 END AS due_at FROM s)
    SELECT *, coalesce(due_at <= {fx.AS_OF}, false) AS is_due FROM d""",
)
def _(t):
    return retry_ledger(t.sql(fx.FILE_LOG), F.lit(fx.AS_OF))


@query(
    "verify_files",
    f"""SELECT file, count(*) AS n_records, bool_and(json_valid(value)) AS all_json FROM ({fx.FILE_LINES}) x GROUP BY 1""",
)
def _(t):
    return file_verdicts(t.sql(fx.FILE_LINES))


@query(
    "file_partition",
    f"""WITH f AS (SELECT file, arg_min(event_type, line_no) AS event_type, arg_min(event_ts, line_no) AS ts FROM ({fx.FILE_LINES}) x GROUP BY 1)
    SELECT file, event_type, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour FROM f""",
)
def _(t):
    lines = t.sql(fx.FILE_LINES).withColumnRenamed("event_type", "type")
    return file_partition(lines.withColumn("timestamp", F.col("event_ts").cast("timestamp")))
