"""Routing: taps, flows, what changed, who gets which event."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventweir.functions.locations import priority_class
from eventweir.operators import routing as ops
from eventweir.plans.flow_table import FlowTable
from eventweir.session import scratch_path
from eventweir.sources.taps import read_discovery, read_static_taps
from workloads import fixtures as fx
from workloads.registry import query


DISCOVERED_SQL = f"""SELECT event_type, flow_id, coalesce(https, http) AS uri,
    CASE qos_delivery WHEN 'retry' THEN 'retry' ELSE 'best_effort' END AS qos, CAST({fx.AS_OF} AS BIGINT) AS last_known
    FROM ({fx.ANNOUNCEMENTS}) a WHERE event_type <> '' AND coalesce(https, http) IS NOT NULL"""

STATIC_SQL = f"""SELECT DISTINCT key, trim(split_part(flow_key, '@', 1)) AS event_type, trim(split_part(flow_key, '@', 2)) AS flow_id, trim(u) AS uri,
    CASE qos_delivery WHEN 'retry' THEN 'retry' ELSE 'best_effort' END AS qos, CAST({fx.AS_OF - 86400} AS BIGINT) AS last_known
    FROM (SELECT key, flow_key, qos_delivery, unnest(string_split(uris, ',')) AS u FROM ({fx.STATIC_TAPS}) s) x WHERE trim(u) <> ''"""
STATIC_SPECS_SQL = f"SELECT event_type, flow_id, uri, qos, last_known FROM ({STATIC_SQL}) st"

OLD_SQL = f"""SELECT event_type, flow_id, list_sort(list(DISTINCT uri)) AS destinations, bool_or(qos) AS qos_enabled, max(last_known) AS last_known
    FROM ({fx.OLD_FLOWS}) o GROUP BY 1, 2"""

CACHED_SQL = f"""SELECT event_type, flow_id, unnest(destinations) AS uri, CASE WHEN qos_enabled THEN 'retry' ELSE 'best_effort' END AS qos, last_known
    FROM ({OLD_SQL}) o WHERE last_known + {fx.TTL} > {fx.AS_OF}
    AND NOT EXISTS (SELECT 1 FROM ({DISCOVERED_SQL}) d WHERE d.event_type = o.event_type AND d.flow_id = o.flow_id)"""

SPECS_SQL = f"""SELECT *, 'static' AS source, 0 AS seq FROM ({STATIC_SPECS_SQL}) s UNION ALL SELECT *, 'discovered', 1 FROM ({DISCOVERED_SQL}) d
    UNION ALL SELECT *, 'cached', 2 FROM ({CACHED_SQL}) c"""

FLOWS_SQL = f"""SELECT event_type, flow_id, list_sort(list(DISTINCT uri)) AS destinations, bool_or(qos = 'retry') AS qos_enabled,
    arg_max(last_known, seq) AS last_known FROM ({SPECS_SQL}) s GROUP BY 1, 2"""


def at(seconds: int):
    return F.lit(seconds).cast("bigint")


def discovered(t):
    return read_discovery(fx.announcements(t), at(fx.AS_OF), allow_http=True)


def static(t):
    return read_static_taps(t.sql(fx.STATIC_TAPS), at(fx.AS_OF - 86400))


def cached(t):
    return ops.retain_cached_flows(fx.old_flows(t), discovered(t), at(fx.AS_OF), fx.TTL)


def specs(t):
    return ops.all_tap_specs(static(t), discovered(t), cached(t))


def flows(t):
    return ops.build_flows(specs(t))


def flat(df, *columns):
    """Lists as text, for comparing."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("tap_specs_discovery", DISCOVERED_SQL)
def _(t):
    return discovered(t)


@query("tap_specs_static", STATIC_SPECS_SQL)
def _(t):
    return static(t)


@query("retain_cached_flows", CACHED_SQL)
def _(t):
    return cached(t)


@query("all_tap_specs", SPECS_SQL)
def _(t):
    return specs(t)


@query(
    "build_flows",
    f"SELECT event_type, flow_id, array_to_string(destinations, ',') AS destinations, qos_enabled, last_known FROM ({FLOWS_SQL}) f",
)
def _(t):
    return flat(flows(t), "destinations")


@query(
    "diff_flows",
    f"""SELECT coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.flow_id, n.flow_id) AS flow_id,
    CASE WHEN o.event_type IS NULL THEN 'CREATE' WHEN n.event_type IS NULL THEN 'TERMINATE' WHEN o.qos_enabled <> n.qos_enabled THEN 'RECREATE'
         WHEN o.destinations <> n.destinations THEN 'RETARGET' ELSE 'KEEP' END AS action
    FROM ({OLD_SQL}) o FULL OUTER JOIN ({FLOWS_SQL}) n ON o.event_type = n.event_type AND o.flow_id = n.flow_id""",
)
def _(t):
    return ops.diff_flows(fx.old_flows(t), flows(t)).select("event_type", "flow_id", "action")


@query(
    "route_events",
    f"""SELECT x.uuid, x.type, f.flow_id, f.qos_enabled FROM ({fx.ENVELOPE}) x JOIN ({FLOWS_SQL}) f ON x.type = f.event_type""",
)
def _(t):
    return ops.route_events(fx.envelope(t), flows(t)).select("uuid", "type", "flow_id", "qos_enabled")


PROBLEMS_SQL = f"""SELECT DISTINCT flow_id, config_id, uri, CASE WHEN uri LIKE '%|%' THEN 'syntax'
    WHEN NOT regexp_matches(lower(uri), '^https?://') THEN 'scheme' END AS problem FROM ({fx.URIS}) u"""


@query("audit_tap_uris", f"SELECT DISTINCT flow_id, uri, problem FROM ({PROBLEMS_SQL}) p WHERE problem IS NOT NULL")
def _(t):
    return ops.audit_tap_uris(t.sql(fx.URIS))


@query(
    "audit_flows",
    f"""SELECT flow_id, count(problem) = 0 AS ok, count(DISTINCT CASE WHEN problem = 'syntax' THEN uri END) AS n_invalid_syntax,
    count(DISTINCT CASE WHEN problem = 'scheme' THEN uri END) AS n_invalid_scheme FROM ({PROBLEMS_SQL}) p GROUP BY 1""",
)
def _(t):
    return ops.audit_flows(t.sql(fx.URIS))


@query(
    "audit_messages",
    f"""WITH m AS (SELECT config_id AS flow_id,
      string_agg(DISTINCT CASE WHEN problem = 'syntax' THEN uri END, ', ' ORDER BY CASE WHEN problem = 'syntax' THEN uri END) AS syn,
      string_agg(DISTINCT CASE WHEN problem = 'scheme' THEN uri END, ', ' ORDER BY CASE WHEN problem = 'scheme' THEN uri END) AS sch
      FROM ({PROBLEMS_SQL}) p WHERE problem IS NOT NULL GROUP BY 1)
    SELECT flow_id, concat('Invalid URIs: ', concat_ws('; ', 'Invalid syntax: ' || syn, 'Invalid scheme: ' || sch)) AS message FROM m""",
)
def _(t):
    # One configuration names at most eight URIs here.
    uris = t.sql(fx.URIS).drop("flow_id").withColumnRenamed("config_id", "flow_id")
    return ops.audit_messages(ops.audit_tap_uris(uris))


@query(
    "priority_class",
    f"""SELECT location, CASE event_type WHEN 'click' THEN 'high' WHEN 'error' THEN 'low' ELSE 'normal' END AS priority FROM ({fx.LISTING}) l""",
)
def _(t):
    return t.sql(fx.LISTING).select("location", priority_class(F.col("event_type"), ["click"], ["error"]).alias("priority"))


@query(
    "refresh_flows",
    f"SELECT event_type, flow_id, array_to_string(destinations, ',') AS destinations, qos_enabled, last_known FROM ({FLOWS_SQL}) f",
)
def _(t):
    """The table starts from the old flows, is refreshed, and a refresh that fails leaves it as it is."""
    table = FlowTable(
        t.spark, scratch_path(t.spark, "flows"), lambda: fx.announcements(t), t.sql(fx.STATIC_TAPS), fx.AS_OF - 86400, fx.TTL, True
    )
    fx.old_flows(t).select("event_type", "flow_id", "destinations", "qos_enabled", "last_known").write.parquet(table._path(1))
    table.version = 1
    table.refresh(fx.AS_OF)

    def unreachable():
        raise ConnectionError("no answer")

    table.announcements = unreachable
    return flat(table.refresh(fx.AS_OF + 10), "destinations")
