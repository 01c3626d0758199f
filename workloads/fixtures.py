"""Inputs of the operators as views over the test tables.

Each text runs unchanged in Spark SQL and in the SQL engine the results are
checked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.functions.locations import combined_location, combined_prefix
from eventweir.schema import GROUP
from workloads.registry import Tables

AS_OF = 1706572800
AS_OF_MS = AS_OF * 1000
TTL = 3600
ACCEPTED = ["click", "purchase", "view"]
ACCEPTED_SQL = "('click', 'purchase', 'view')"
TARGET = 512 * 1024 * 1024

ENVELOPE = """
SELECT event_type AS type, CAST(event_id AS VARCHAR(20)) AS uuid,
       concat('host', CAST(user_id % 16 AS VARCHAR(20))) AS host, ts AS event_ts, props AS data,
       event_id AS seq
FROM events"""

FAULTY = """
SELECT CAST(floor(event_id / 50) AS BIGINT) AS batch_id, event_id AS seq,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '0bad'
            WHEN event_id % 83 = 0 THEN 'no-name' ELSE event_type END AS type,
       CASE WHEN event_id % 79 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR(20)) END AS uuid,
       CASE WHEN event_id % 73 = 0 THEN NULL ELSE concat('host', CAST(user_id % 16 AS VARCHAR(20))) END AS host,
       CASE WHEN event_id % 71 = 0 THEN NULL ELSE ts END AS event_ts,
       CASE WHEN event_id % 67 = 0 THEN NULL ELSE props END AS data
FROM events"""

# Faulty events in bodies: some payloads are JSON, but no objects.
FAULTY_BODIES = FAULTY.replace(
    "% 67 = 0 THEN NULL", """% 67 = 0 THEN NULL WHEN event_id % 61 = 0 THEN '"text"' WHEN event_id % 59 = 0 THEN '[1]'"""
)

ANNOUNCEMENTS = """
SELECT s_suppkey AS ann_id,
       CASE WHEN s_suppkey % 23 = 0 THEN NULL WHEN s_suppkey % 19 = 0 THEN ''
            WHEN s_suppkey % 5 = 0 THEN 'click' WHEN s_suppkey % 5 = 1 THEN 'view'
            WHEN s_suppkey % 5 = 2 THEN 'purchase' WHEN s_suppkey % 5 = 3 THEN 'signup' ELSE 'error' END AS event_type,
       concat('f', CAST(s_suppkey % 4 AS VARCHAR(20))) AS flow_id,
       CASE WHEN s_suppkey % 3 <> 0 THEN concat('http://tap', CAST(s_suppkey % 12 AS VARCHAR(20)), '.example:8080') END AS http,
       CASE WHEN s_suppkey % 7 = 0 THEN concat('https://tap', CAST(s_suppkey % 12 AS VARCHAR(20)), '.example:8443') END AS https,
       CASE WHEN s_suppkey % 6 = 0 THEN 'retry' WHEN s_suppkey % 6 = 1 THEN 'bestEffort' END AS qos_delivery
FROM supplier"""

STATIC_TAPS = """
SELECT s_suppkey AS key,
       concat(' ', CASE s_suppkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'legacy' END, ' @ s',
              CAST(s_nationkey AS VARCHAR(20)), ' ') AS flow_key,
       concat(' http://static', CAST(s_suppkey % 8 AS VARCHAR(20)), '.example:8080 ,, https://b.example/p,http://static',
              CAST(s_suppkey % 8 AS VARCHAR(20)), '.example:8080') AS uris,
       CASE WHEN s_acctbal < 1000 THEN 'retry' WHEN s_acctbal < 5000 THEN 'bestEffort' END AS qos_delivery
FROM supplier"""

OLD_FLOWS = """
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase'
            WHEN 3 THEN 'signup' WHEN 4 THEN 'error' ELSE 'legacy' END AS event_type,
       concat('f', CAST(s_suppkey % 5 AS VARCHAR(20))) AS flow_id,
       concat('http://tap', CAST(s_suppkey % 12 AS VARCHAR(20)), '.example:8080') AS uri,
       s_suppkey % 6 = 0 AS qos,
       CAST(1706572800 - (s_suppkey % 30) * 240 AS BIGINT) AS last_known
FROM supplier"""

LISTING = """
SELECT event_type, date, hour, size, etag, last_modified, priority, price, key,
       concat('s3://staging/', event_type, '/', date, '/', hour, '/', name) AS location,
       CASE WHEN size < 5242880 THEN 'small' ELSE 'large' END AS size_class
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'view' ELSE 'error' END AS event_type,
             concat(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 4), '-01-01') AS date,
             lpad(CAST(o_orderkey % 5 AS VARCHAR(20)), 2, '0') AS hour,
             CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS BIGINT)
                  WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT)
                  ELSE CAST(floor(o_totalprice * 1000) AS BIGINT) END AS size,
             concat('etag', CAST(o_orderkey AS VARCHAR(20))) AS etag, CAST(o_orderkey AS BIGINT) AS last_modified,
             o_orderpriority AS priority, o_totalprice AS price, o_orderkey AS key,
             concat('part-', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0'), '.json.snappy') AS name
      FROM orders) o"""

# Files of an earlier pass, and how staging looks now: some of them are gone or were replaced.
EARLIER = "priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
STAGED = f"""
SELECT event_type, date, hour, size_class, location, size, last_modified, priority, key,
       CASE WHEN {EARLIER} AND price BETWEEN 20000 AND 30000 THEN concat(etag, 'x') ELSE etag END AS etag
FROM ({LISTING}) l
WHERE size > 0 AND NOT ({EARLIER} AND price < 20000)"""

# Parts of the earlier pass's combined objects; an object has at most 2000.
PARTS = f"""
SELECT event_type, date, hour, size_class, CAST(floor(key / 2000) AS BIGINT) AS ordinal,
       location, etag, size, last_modified
FROM ({LISTING}) l
WHERE size > 0 AND {EARLIER}"""

ATTEMPTS = """
SELECT CASE l_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase'
            WHEN 3 THEN 'signup' ELSE 'error' END AS event_type,
       concat('f', CAST(l_orderkey % 20 AS VARCHAR(20))) AS flow_id, l_orderkey AS batch_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS attempt_no,
       concat('http://tap', CAST(l_suppkey % 3 AS VARCHAR(20)), '.example') AS uri,
       CASE WHEN l_quantity <= 2 THEN NULL WHEN l_returnflag = 'A' THEN 202
            WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 404 ELSE 503 END AS status_code,
       1 + l_orderkey % 100 AS n_events
FROM lineitem"""

# Overflow drops noticed before a batch, and taps added to a flow again.
DROPS = """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase'
            WHEN 3 THEN 'signup' ELSE 'error' END AS event_type,
       concat('f', CAST(o_orderkey % 20 AS VARCHAR(20))) AS flow_id, o_orderkey AS batch_id,
       CASE WHEN o_totalprice > 450000 THEN CAST(1 + o_custkey % 9 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_dropped
FROM orders"""

TAP_EPOCHS = """
SELECT concat('f', CAST(o_orderkey % 20 AS VARCHAR(20))) AS flow_id, o_orderkey AS batch_id,
       concat('http://tap', CAST(o_custkey % 3 AS VARCHAR(20)), '.example') AS uri
FROM orders WHERE o_totalprice > 480000"""

FILE_LINES = """
SELECT concat('file-', CAST(CAST(floor(event_id / 200) AS BIGINT) AS VARCHAR(20))) AS file, event_id % 200 AS line_no,
       CASE WHEN CAST(floor(event_id / 200) AS BIGINT) % 11 = 0 AND event_id % 200 = 150 THEN '{"type":'
            ELSE concat('{"type":"', event_type, '","uuid":"', CAST(event_id AS VARCHAR(20)), '"}') END AS value,
       event_type, ts AS event_ts
FROM events"""

ARRIVALS = """
SELECT event_type AS flow_id, CAST(substring(CAST(ts AS VARCHAR(30)), 9, 2) AS INT) AS tick, count(*) AS arrivals
FROM events GROUP BY 1, 2"""

FILE_LOG = """
SELECT concat('file-', CAST(conv_id AS VARCHAR(20))) AS file,
       turn + 1 AS attempt,
       CASE role WHEN 'assistant' THEN 'failure' WHEN 'user' THEN 'success' ELSE 'corrupt' END AS outcome,
       CASE conv_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS event_type,
       CAST(length(text) AS BIGINT) AS duration_ms,
       CAST(1706572800 - conv_id + turn * 100 AS BIGINT) AS finished_at
FROM conversations"""

URIS = """
SELECT concat('f', CAST(page_id % 20 AS VARCHAR(20))) AS flow_id, concat('g', CAST(CAST(floor(page_id / 8) AS BIGINT) AS VARCHAR(20))) AS config_id,
       CASE WHEN page_id % 13 = 0 THEN concat(url, '|x') WHEN page_id % 11 = 0 THEN concat('ftp', substring(url, 5))
            WHEN page_id % 17 = 0 THEN concat('HTTP', substring(url, 5)) ELSE url END AS uri
FROM pages"""


def envelope(t: Tables, text: str = ENVELOPE) -> DataFrame:
    return t.sql(text).withColumn("timestamp", F.col("event_ts").cast("timestamp")).drop("event_ts")


def announcements(t: Tables) -> DataFrame:
    """Announcements as property maps; absent properties are not in the map."""
    pairs = {"eventType": "event_type", "flowId": "flow_id", "http": "http", "https": "https", "qos.delivery": "qos_delivery"}
    entries = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))) for k, c in pairs.items()])
    )
    return t.sql(ANNOUNCEMENTS).select("ann_id", F.map_from_entries(entries).alias("properties"))


def old_flows(t: Tables) -> DataFrame:
    return t.sql(OLD_FLOWS).groupBy("event_type", "flow_id").agg(
        F.array_sort(F.collect_set("uri")).alias("destinations"),
        F.max("qos").alias("qos_enabled"),
        F.max("last_known").alias("last_known"),
    )


def manifest(t: Tables) -> DataFrame:
    """The earlier pass as manifest rows."""
    part = F.struct("location", "etag", "size", "last_modified")
    objects = t.sql(PARTS).groupBy(*GROUP, "ordinal").agg(F.array_sort(F.collect_list(part)).alias("source_parts"))
    prefix = combined_prefix("s3://target", F.col("size_class"))
    return objects.select(
        *GROUP,
        prefix.alias("location_prefix"),
        F.lit(7).cast("bigint").alias("version"),
        F.lit("nodeA").alias("creator"),
        F.lit(AS_OF_MS - 600_000).cast("bigint").alias("updated_ts"),
        "ordinal",
        combined_location(prefix, F.col("ordinal")).alias("location"),
        F.lit(AS_OF_MS - 600_000).cast("bigint").alias("object_updated_ts"),
        "source_parts",
    )
