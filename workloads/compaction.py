"""Compaction: listings, manifests, packing, rewriting; and the streams that feed it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventweir.functions.locations import size_class
from eventweir.functions.transfer import put_file
from eventweir.operators import combine as ops
from eventweir.operators.files import quarantine_corrupt, verify_files
from eventweir.operators.packing import pack_first_fit
from eventweir.plans.combine import CombineConfig, run_combine
from eventweir.plans.ingest import accepted_events
from eventweir.plans.recover import Recovery, read_attempts, recover_files
from eventweir.plans.schedule import run_due
from eventweir.schema import GROUP, MANIFEST
from eventweir.session import scratch_path, written_table
from eventweir.sinks.manifests import claim_groups, write_manifest, write_snapshot
from eventweir.sinks.spool import read_spool_lines, spool_lines, write_spool
from eventweir.sources.events import stream_events
from eventweir.sources.listing import list_partitions, with_bucket, with_location_parts
from eventweir.sources.manifests import explode_parts, group_headers, read_headers, read_manifests
from eventweir.streaming.pipelines import run_ingest, stream_backlog
from workloads import fixtures as fx
from workloads.ingest import bodies
from workloads.registry import query

G = ", ".join(GROUP)
PREFIX_SQL = "concat('s3://target/', event_type, '/', date, '/', hour, '.', size_class)"
LOCATION_SQL = f"concat({PREFIX_SQL}, printf('.%05d.json.snappy', ordinal))"


@query(
    "list_objects",
    f"""SELECT location, split_part(location, '/', 3) AS bucket, regexp_replace(location, '^s3://[^/]*/', '') AS key,
    regexp_replace(location, '[^/]*$', '') AS dir, split_part(location, '/', 7) AS name, size, etag, last_modified FROM ({fx.LISTING}) l""",
)
def _(t):
    listed = with_location_parts(t.sql(fx.LISTING).drop("key"))
    return listed.select("location", "bucket", "key", "dir", "name", "size", "etag", "last_modified")


@query(
    "list_partitions",
    f"""SELECT DISTINCT split_part(location, '/', 4) AS event_type, split_part(location, '/', 5) AS date, split_part(location, '/', 6) AS hour
    FROM ({fx.LISTING}) l""",
)
def _(t):
    return list_partitions(with_bucket(t.sql(fx.LISTING).select("location")))


@query(
    "date_window",
    f"SELECT location, date FROM ({fx.LISTING}) l WHERE date >= '1996-01-02' AND date < '1999-01-02'",
)
def _(t):
    found = ops.date_window(t.sql(fx.LISTING), dt.date(1999, 1, 1), start_days_ago=3 * 365)
    return found.select("location", "date")


@query(
    "size_class",
    f"SELECT location, CASE WHEN size < 5242880 THEN 'small' ELSE 'large' END AS size_class FROM ({fx.LISTING}) l WHERE size <> 0",
)
def _(t):
    return ops.with_size_class(t.sql(fx.LISTING).drop("size_class")).select("location", "size_class")


@query(
    "manifest_parts",
    f"""SELECT {G}, ordinal, {LOCATION_SQL} AS object_location, row_number() OVER (PARTITION BY {G}, ordinal ORDER BY location) - 1 AS part_no,
    location, etag, size, last_modified FROM ({fx.PARTS}) p""",
)
def _(t):
    return explode_parts(fx.manifest(t)).withColumn("part_no", F.col("part_no").cast("bigint"))


@query(
    "write_manifest",
    f"""SELECT {G}, ordinal, {LOCATION_SQL} AS location, CASE WHEN event_type = 'click' THEN 8 ELSE 7 END AS version, count(*) AS n_parts
    FROM ({fx.PARTS}) p GROUP BY {G}, ordinal""",
)
def _(t):
    """Two passes are stored; reading gives each object at its latest version."""
    root = scratch_path(t.spark, "manifest")
    write_manifest(fx.manifest(t), root, 1)
    write_manifest(fx.manifest(t).where("event_type = 'click'").withColumn("version", F.lit(8).cast("bigint")), root, 2)
    stored = read_manifests(t.spark, root)
    return stored.select(*GROUP, "ordinal", "location", "version", F.size("source_parts").cast("bigint").alias("n_parts"))


@query(
    "manifest_snapshot",
    f"""WITH o AS (SELECT {G}, ordinal, count(*) AS n_parts FROM ({fx.PARTS}) p GROUP BY {G}, ordinal)
    SELECT {G}, ordinal, n_parts, CASE WHEN hour = '01' THEN 10 WHEN hour = '00' THEN 9 WHEN event_type = 'click' THEN 8 ELSE 7 END AS version,
           max(ordinal) OVER (PARTITION BY {G}) + 1 AS next_ordinal FROM o""",
)
def _(t):
    """Two passes, a snapshot of them, a pass after it, and one of an older name that ends last."""
    root = scratch_path(t.spark, "manifest")
    first = written_table(fx.manifest(t), "manifest")

    def update(where: str, version: int, name: int):
        write_manifest(first.where(where).withColumn("version", F.lit(version).cast("bigint")), root, name)

    update("true", 7, 1)
    update("event_type = 'click'", 8, 3)
    write_snapshot(t.spark, root, "000000000003")
    update("hour = '00'", 9, 4)
    update("hour = '01'", 10, 2)
    stored = read_manifests(t.spark, root).join(read_headers(t.spark, root).select(*GROUP, "n_objects"), GROUP)
    n_parts = F.size("source_parts").cast("bigint").alias("n_parts")
    return stored.select(*GROUP, "ordinal", n_parts, F.col("version").cast("int").alias("version"), F.col("n_objects").alias("next_ordinal"))


@query(
    "uncombined_objects",
    f"SELECT location, size_class FROM ({fx.STAGED}) s WHERE NOT EXISTS (SELECT 1 FROM ({fx.PARTS}) p WHERE p.location = s.location)",
)
def _(t):
    return ops.uncombined_objects(t.sql(fx.STAGED), explode_parts(fx.manifest(t))).select("location", "size_class")


STATUS_SQL = f"""SELECT p.event_type, p.date, p.hour, p.size_class, p.ordinal, bool_and(s.location IS NOT NULL) AS all_available,
    bool_and(s.location IS NOT NULL AND s.etag = p.etag AND s.size = p.size) AS matches, CAST(sum(p.size) AS BIGINT) AS size, count(*) AS n_parts
    FROM ({fx.PARTS}) p LEFT JOIN ({fx.STAGED}) s ON p.location = s.location GROUP BY 1, 2, 3, 4, 5"""


@query("parts_status", STATUS_SQL)
def _(t):
    return ops.parts_status(fx.manifest(t), t.sql(fx.STAGED))


@query(
    "bad_manifests",
    f"""SELECT DISTINCT {G} FROM ({STATUS_SQL}) b WHERE size < {fx.TARGET} AND all_available AND NOT matches AND ({G}) IN
    (SELECT ({G}) FROM ({fx.STAGED}) s WHERE NOT EXISTS (SELECT 1 FROM ({fx.PARTS}) p WHERE p.location = s.location))""",
)
def _(t):
    manifest, staged = fx.manifest(t), t.sql(fx.STAGED)
    return ops.bad_manifests(ops.parts_status(manifest, staged), ops.uncombined_objects(staged, explode_parts(manifest)))


# Targets as they are: those of hour 04 are missing, those of hour 03 have another size.
OBJECTS_SQL = f"SELECT {G}, ordinal, CAST(sum(size) AS BIGINT) AS size FROM ({fx.PARTS}) p GROUP BY {G}, ordinal"
TARGETS_SQL = f"""SELECT concat('s3://target/', event_type, '/', date, '/', hour, '.', size_class, '.', lpad(CAST(ordinal AS VARCHAR(20)), greatest(5, length(CAST(ordinal AS VARCHAR(20)))), '0'), '.json.snappy') AS location,
    CASE WHEN hour = '03' THEN size + 1 ELSE size END AS size FROM ({OBJECTS_SQL}) o WHERE hour <> '04'"""


@query(
    "combine_worklist",
    f"""SELECT {G}, ordinal, {LOCATION_SQL} AS location, size, n_parts, CASE WHEN hour = '03' THEN size + 1 END AS target_size
    FROM ({STATUS_SQL}) st WHERE all_available AND hour IN ('03', '04')""",
)
def _(t):
    work = ops.combine_worklist(fx.manifest(t), t.sql(fx.STAGED), t.sql(TARGETS_SQL))
    return work.drop("source_parts")


HEADERS = f"""SELECT event_type, date, hour, size_class, count(*) AS version, CASE event_type WHEN 'click' THEN 'nodeA' ELSE 'nodeB' END AS creator,
    CAST({fx.AS_OF_MS} - CAST(hour AS INT) * 100000 AS BIGINT) AS updated_ts,
    concat('s3://target/', event_type, '/', date, '/', hour, '.', size_class) AS location_prefix
    FROM ({fx.LISTING}) l GROUP BY event_type, date, hour, size_class"""


@query(
    "writable_groups",
    f"SELECT {G}, version, creator, updated_ts FROM ({HEADERS}) h WHERE creator = 'nodeA' OR {fx.AS_OF_MS} - updated_ts >= 300000",
)
def _(t):
    return ops.writable_groups(t.sql(HEADERS), "nodeA", fx.AS_OF_MS).drop("location_prefix")


PROPOSED = f"""SELECT event_type, date, hour, size_class, location_prefix,
    CASE WHEN event_type = 'error' AND hour = '00' THEN 0 WHEN hour = '02' THEN version - 1 ELSE version END AS read_version FROM ({HEADERS}) h"""


@query(
    "manifest_conflicts",
    f"""SELECT {G}, read_version, CASE WHEN event_type <> 'error' THEN version END AS stored_version,
    CASE WHEN read_version = CASE WHEN event_type <> 'error' THEN version ELSE 0 END THEN 'commit' ELSE 'conflict' END AS status
    FROM (SELECT p.*, h.version FROM ({PROPOSED}) p JOIN ({HEADERS}) h USING ({G})) x""",
)
def _(t):
    stored = t.sql(HEADERS).where("event_type <> 'error'")
    return ops.manifest_conflicts(stored, t.sql(PROPOSED))


@query(
    "manifest_commit",
    f"""WITH g AS (SELECT {G}, max(ordinal) + 1 AS n FROM ({OBJECTS_SQL}) o GROUP BY {G})
    SELECT {G}, CAST(n AS BIGINT) AS next_ordinal, CASE WHEN hour = '04' THEN 7 WHEN hour IN ('00', '01') THEN 8 ELSE 9 END AS version,
           CASE WHEN hour = '04' THEN 'nodeA' WHEN hour IN ('00', '01') THEN 'early' ELSE 'late' END AS creator,
           CASE WHEN hour IN ('00', '01', '04') THEN 'conflict' ELSE 'commit' END AS second_status FROM g""",
)
def _(t):
    """Three writers replace version 7: one that commits two hours, one that
    claims an hour and dies within its lease, and one that wants all."""
    root = scratch_path(t.spark, "manifest")
    first = written_table(fx.manifest(t), "manifest")
    write_manifest(first, root, 1)
    headers = group_headers(first).select(*GROUP, F.col("version").alias("read_version"))
    early, dying = headers.where("hour IN ('00', '01')"), headers.where("hour = '04'")

    def update(claims, version: int, creator: str):
        mine = first.join(claims.where("status = 'commit'").select(*GROUP), GROUP, "left_semi")
        return mine.withColumns({"version": F.lit(version).cast("bigint"), "creator": F.lit(creator)})

    write_manifest(update(claim_groups(early, root, "2-early", fx.AS_OF_MS), 8, "early"), root, "2-early")
    claimed = update(claim_groups(dying, root, "3-dying", fx.AS_OF_MS), 8, "dying")
    claimed.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("date").parquet(f"{root}/pass=3-dying")
    second = claim_groups(headers, root, "4-late", fx.AS_OF_MS + 1000)
    write_manifest(update(second, 9, "late"), root, "4-late")
    stored = group_headers(read_manifests(t.spark, root))
    return stored.join(second, GROUP).select(*GROUP, F.col("n_objects").alias("next_ordinal"), F.col("version").cast("int").alias("version"), "creator", F.col("status").alias("second_status"))


def packed_sql(rank: str) -> str:
    """First fit with at most one open object per group, files in order of ``rank``."""
    return f"""WITH RECURSIVE o AS (
      SELECT event_type, date, hour, size_class, location, size, {rank} AS pass,
         row_number() OVER (PARTITION BY event_type, date, hour, size_class ORDER BY {rank}, location) AS rn
      FROM ({fx.LISTING}) l WHERE size > 0),
    r AS (
      SELECT event_type, date, hour, size_class, location, size, rn, 0 AS bin, size AS acc, 0 AS part_no FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_type, o.date, o.hour, o.size_class, o.location, o.size, o.rn,
         CASE WHEN r.acc >= {fx.TARGET} THEN r.bin + 1 ELSE r.bin END,
         CASE WHEN r.acc >= {fx.TARGET} THEN o.size ELSE r.acc + o.size END,
         CASE WHEN r.acc >= {fx.TARGET} THEN 0 ELSE r.part_no + 1 END
      FROM r JOIN o ON o.event_type = r.event_type AND o.date = r.date AND o.hour = r.hour
                   AND o.size_class = r.size_class AND o.rn = r.rn + 1)"""


@query(
    "pack_first_fit",
    f"""{packed_sql('0')} SELECT {G}, location, CAST(bin AS BIGINT) AS ordinal, CAST(part_no AS BIGINT) AS part_no FROM r""",
)
def _(t):
    files = ops.with_size_class(t.sql(fx.LISTING).drop("size_class"))
    return pack_first_fit(files, target=fx.TARGET).select(*GROUP, "location", "ordinal", "part_no")


@query(
    "next_manifest",
    f"""{packed_sql(f"CASE WHEN {fx.EARLIER} THEN 1 ELSE 2 END")},
    v AS (SELECT {G}, count(*) AS version FROM r GROUP BY {G})
    SELECT {G}, CAST(bin AS BIGINT) AS ordinal, version, concat('s3://target/', event_type, '/', date, '/', hour, '.', size_class, printf('.%05d.json.snappy', bin)) AS location,
      count(*) AS n_parts, CAST(sum(size) AS BIGINT) AS size, md5(string_agg(location, ',' ORDER BY rn)) AS parts
    FROM r JOIN v USING ({G}) GROUP BY {G}, bin, version""",
)
def _(t):
    """The files of an earlier pass are packed first, then the others on top of that manifest."""
    files = t.sql(fx.LISTING).where("size > 0")
    empty = t.spark.createDataFrame([], MANIFEST)
    first = pack_first_fit(files.where(fx.EARLIER), target=fx.TARGET)
    manifest = written_table(ops.next_manifest(empty, first, "s3://target", "nodeA", fx.AS_OF_MS), "manifest")
    numbers = group_headers(manifest).select(*GROUP, F.col("n_objects").alias("next_ordinal"))
    growable = ops.open_objects(ops.parts_status(manifest, files), fx.TARGET)
    fresh = ops.uncombined_objects(files, explode_parts(manifest))
    placed = pack_first_fit(fresh, growable, numbers, fx.TARGET)
    latest = ops.next_manifest(manifest, placed, "s3://target", "nodeA", fx.AS_OF_MS + 1000)
    parts = F.col("source_parts")
    return latest.select(
        *GROUP,
        "ordinal",
        "version",
        "location",
        F.size(parts).cast("bigint").alias("n_parts"),
        F.aggregate(parts["size"], F.lit(0).cast("bigint"), lambda a, b: a + b).alias("size"),
        F.md5(F.array_join(parts["location"], ",")).alias("parts"),
    )


@query(
    "combine_completed",
    f"SELECT DISTINCT 'CombineCompleted' AS type, 'nightly' AS group_id, event_type FROM ({fx.LISTING}) l",
)
def _(t):
    events = ops.combine_completed(t.sql(fx.LISTING), "nightly", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return events.select(
        "type", F.get_json_object("data", "$.groupId").alias("group_id"), F.get_json_object("data", "$.eventType").alias("event_type")
    )


def combine_config(t, staging: str, **settings) -> CombineConfig:
    return CombineConfig(
        staging_root=staging,
        target_root=scratch_path(t.spark, "combined"),
        manifest_root=scratch_path(t.spark, "manifest"),
        **settings,
    )


def combined_events(t, config: CombineConfig):
    """Events in the combined objects, with the hour their location says."""
    lines = t.spark.read.option("recursiveFileLookup", True).text(config.target_root)
    path = F.col("_metadata.file_path")
    return lines.select(
        F.get_json_object("value", "$.type").alias("event_type"),
        F.get_json_object("value", "$.uuid").alias("uuid"),
        F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})/\d{2}\.small", 1).alias("date"),
        F.regexp_extract(path, r"/(\d{2})\.small\.\d{5}\.", 1).alias("hour"),
    )


COMBINED_SQL = f"""SELECT type AS event_type, uuid, strftime(event_ts, '%Y-%m-%d') AS date, strftime(event_ts, '%H') AS hour FROM ({fx.ENVELOPE}) x"""
COMBINE_AT = dt.datetime(2024, 1, 31, 12)


@query("compact_roundtrip", COMBINED_SQL)
def _(t):
    staging = scratch_path(t.spark, "staging")
    write_spool(fx.envelope(t), staging, max_records=50)
    config = combine_config(t, staging, start_days_ago=60, target_size=4000)
    run_combine(t.spark, config, COMBINE_AT)
    return combined_events(t, config)


@query("recombine_late", COMBINED_SQL)
def _(t):
    """Events that arrive after their hour was combined are there after the next pass."""
    staging = scratch_path(t.spark, "staging")
    config = combine_config(t, staging, start_days_ago=60)
    events = fx.envelope(t).withColumn("late", F.col("host").isin("host1", "host5"))
    write_spool(events.where("NOT late").drop("late"), staging)
    run_combine(t.spark, config, COMBINE_AT)
    write_spool(events.where("late").drop("late"), staging)
    run_combine(t.spark, config, COMBINE_AT + dt.timedelta(minutes=1))
    return combined_events(t, config)


@query("run_combine", f"SELECT DISTINCT type AS event_type, CAST(0 AS BIGINT) AS placed, CAST(0 AS BIGINT) AS rewritten FROM ({fx.ENVELOPE}) x")
def _(t):
    """A second pass over unchanged files places nothing, rewrites nothing, and still announces every type."""
    staging = scratch_path(t.spark, "staging")
    write_spool(fx.envelope(t), staging)
    config = combine_config(t, staging, start_days_ago=60)
    run_combine(t.spark, config, COMBINE_AT)
    announced = []
    again = run_combine(t.spark, config, COMBINE_AT + dt.timedelta(minutes=1), announce=announced.append)
    return announced[0].select(
        F.get_json_object("data", "$.eventType").alias("event_type"),
        F.lit(again.placed.count()).cast("bigint").alias("placed"),
        F.lit(again.log.count()).cast("bigint").alias("rewritten"),
    )


@query(
    "combine_schedule",
    f"""WITH e AS (SELECT type AS event_type, count(*) AS n, count(*) FILTER (WHERE seq % 2 = 0) AS n_early FROM ({fx.ENVELOPE}) x GROUP BY 1)
    SELECT CAST(tick AS INTEGER) AS tick, event_type, 'combined' AS status, CASE WHEN tick = 2 OR (tick = 3 AND event_type <> 'error') THEN n ELSE n_early END AS n_combined
    FROM e, (VALUES (1), (2), (3)) t(tick) WHERE (tick = 2) = (event_type = 'error')""",
)
def _(t):
    """Half of the events of all types but one arrive, then the rest and a new type.  New types are due at
    once, others after their delay; beside each run the events its type has in combined objects."""
    staging = scratch_path(t.spark, "staging")
    config = combine_config(t, staging, start_days_ago=60)
    schedule = scratch_path(t.spark, "schedule")
    events, new = fx.envelope(t), F.col("type") == "error"
    done = []
    for tick, (arriving, seconds) in enumerate(((~new & (F.col("seq") % 2 == 0), 0), (new | (F.col("seq") % 2 == 1), 200), (None, 300)), 1):
        if arriving is not None:
            write_spool(events.where(arriving), staging)
        ran = run_due(t.spark, config, schedule, COMBINE_AT + dt.timedelta(seconds=seconds), delay=300)
        held = combined_events(t, config).groupBy("event_type").agg(F.count("*").alias("n_combined"))
        ran = ran.join(held, "event_type").select(F.lit(tick).alias("tick"), "event_type", "status", "n_combined")
        done.append(written_table(ran, "tick"))
    return done[0].unionByName(done[1]).unionByName(done[2])


@query(
    "quarantine_corrupt",
    f"""SELECT type AS event_type, 'ok' AS status, count(*) AS n_records FROM ({fx.ENVELOPE}) x GROUP BY 1
    UNION ALL SELECT type, 'corrupt', count(*) FROM ({fx.ENVELOPE}) x GROUP BY 1""",
)
def _(t):
    """Half of the spooled files get a broken line and are moved away."""
    root = scratch_path(t.spark, "files")
    good, bad = f"{root}/staging/good", f"{root}/staging/bad"
    lines = spool_lines(fx.envelope(t)).select("event_type", "value")
    lines.repartition("event_type").write.partitionBy("event_type").option("compression", "gzip").text(good)
    broken = lines.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.lit('{"type":').alias("value"))
    both = lines.unionByName(broken).repartition("event_type").write.partitionBy("event_type").option("compression", "gzip")
    both.text(bad)
    verdicts = verify_files(t.spark, f"{root}/staging")
    verdicts = written_table(verdicts, "verdicts")
    quarantine_corrupt(verdicts, f"{root}/failed")
    after = verify_files(t.spark, root)
    place = F.when(F.col("file").contains("/failed/"), "corrupt").otherwise("ok")
    named = F.coalesce("first_type", F.lit("?"))
    return after.where(place == F.col("status")).groupBy(named.alias("event_type"), place.alias("status")).agg(F.sum("n_records").alias("n_records"))


RECOVERED = f"""
SELECT type AS event_type, seq % 4 AS kind, count(*) AS n_records, min_by(event_ts, seq) AS first_ts
FROM ({fx.ENVELOPE}) x GROUP BY 1, 2"""


@query(
    "recover_files",
    f"""WITH f AS (SELECT *, strftime(first_ts, '%Y-%m-%d') AS date, strftime(first_ts, '%H') AS hour FROM ({RECOVERED}) x),
    a AS (SELECT 1 AS pass, 1 AS attempt, CASE kind WHEN 0 THEN 'corrupt' WHEN 3 THEN 'success' ELSE 'failure' END AS outcome, * FROM f
    UNION ALL SELECT 3, 2, CASE kind WHEN 1 THEN 'success' ELSE 'failure' END, * FROM f WHERE kind IN (1, 2)),
    c AS (SELECT event_type, date, hour, sum(n_records) AS n FROM a WHERE outcome = 'success' GROUP BY 1, 2, 3)
    SELECT CAST(pass AS INTEGER) AS pass, CAST(attempt AS INTEGER) AS attempt, outcome, CAST(kind AS INTEGER) AS kind,
      CASE WHEN outcome <> 'corrupt' THEN a.event_type END AS event_type, CASE WHEN outcome <> 'corrupt' THEN a.date END AS date,
      CASE WHEN outcome <> 'corrupt' THEN a.hour END AS hour, n_records, CASE WHEN outcome = 'success' THEN CAST(c.n AS BIGINT) END AS n_in_bucket
    FROM a LEFT JOIN c ON a.event_type = c.event_type AND a.date = c.date AND a.hour = c.hour""",
)
def _(t):
    """Files of four kinds per type: with a broken line, refused once by the store, always refused, and good.
    Three passes, the second before anything is due; beside each file stored, what its bucket holds in the end."""
    root = scratch_path(t.spark, "recovery")
    events = fx.envelope(t).withColumn("kind", (F.col("seq") % 4).cast("int"))
    lines = spool_lines(events, "kind", "seq").select("event_type", "kind", "seq", "value")
    last = lines.where("kind = 0").groupBy("event_type", "kind").agg((F.max("seq") + 1).alias("seq"), F.lit("{").alias("value"))
    lines = lines.unionByName(last).repartition("event_type", "kind").sortWithinPartitions("event_type", "kind", "seq")
    lines.drop("seq").write.partitionBy("event_type", "kind").option("compression", "gzip").text(f"{root}/staging")

    def refusing(*kinds):
        def put(source, target):
            if any(f"/kind={k}/" in source for k in kinds):
                raise OSError("not now")
            put_file(source, target)

        return put

    folders = [f"{root}/{name}" for name in ("staging", "target", "failed", "log")]
    for at, kinds in ((1000, (1, 2)), (1299, ()), (1300, (2,))):
        config = Recovery(*folders, period=300, put=refusing(*kinds))
        recover_files(t.spark, config, at)
    stored = read_spool_lines(t.spark, f"{root}/target").groupBy("event_type", "date", "hour").agg(F.count("*").alias("n_in_bucket"))
    log = read_attempts(t.spark, config).withColumn("kind", F.regexp_extract("file", "/kind=([0-9])/", 1).cast("int"))
    log = log.join(stored, ["event_type", "date", "hour"], "left")
    held = F.when(F.col("outcome") == "success", F.col("n_in_bucket")).alias("n_in_bucket")
    return log.select("pass", "attempt", "outcome", "kind", "event_type", "date", "hour", "n_records", held)


def written_batches(t, text=fx.ENVELOPE) -> str:
    """Request bodies as files to stream in."""
    path = scratch_path(t.spark, "arriving")
    bodies(t, text).select("body").write.text(path)
    return path


@query(
    "stream_ingest",
    f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n_events
    FROM events WHERE event_type IN {fx.ACCEPTED_SQL} GROUP BY 1, 2, 3""",
)
def _(t):
    """The stream spools what the batch job counts in ``hourly_partition_counts``."""
    spool = scratch_path(t.spark, "spool")
    stream = stream_events(t.spark, written_batches(t))
    ingesting = run_ingest(stream, scratch_path(t.spark, "checkpoint"), fx.ACCEPTED, spool, trigger={"availableNow": True})
    ingesting.awaitTermination()
    lines = t.spark.read.schema("value string, event_type string, date string, hour string, batch string").text(spool)
    return lines.groupBy("event_type", "date", "hour").agg(F.count("*").alias("n_events"))


def reported(t, kind: str):
    """What a stream of faulty events reports."""
    root = scratch_path(t.spark, "reports")
    stream = stream_events(t.spark, written_batches(t, fx.FAULTY_BODIES))
    spool, checkpoint = scratch_path(t.spark, "spool"), scratch_path(t.spark, "checkpoint")
    run_ingest(stream, checkpoint, fx.ACCEPTED, spool, trigger={"availableNow": True}, reports=root).awaitTermination()
    return t.spark.read.parquet(f"{root}/{kind}")


WANTED_SQL = f"SELECT * FROM ({fx.FAULTY_BODIES}) x WHERE type IS NULL OR type IN {fx.ACCEPTED_SQL}"
MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{field}' AS field, 'is missing' AS message FROM ({WANTED_SQL}) w WHERE {column} IS NULL"
    for field, column in (("type", "type"), ("uuid", "uuid"), ("host", "host"), ("timestamp", "event_ts"), ("data", "data"))
)


@query(
    "stream_rejects",
    f"""SELECT field, message, count(*) AS n_events FROM (
        {MISSING_SQL} UNION ALL
        SELECT 'data', 'is no JSON object' FROM ({WANTED_SQL}) w WHERE data LIKE '"%' OR data LIKE '[%') p GROUP BY 1, 2""",
)
def _(t):
    """Why events of a stream cannot be stored."""
    found = reported(t, "rejects").select(F.explode("problems").alias("p")).select("p.field", "p.message")
    return found.groupBy("field", "message").agg(F.count("*").alias("n_events"))


@query(
    "stream_verdicts",
    f"""WITH b AS (
        SELECT batch_id, count(*) AS n_events,
               string_agg(DISTINCT CASE WHEN type IS NULL THEN 'null' WHEN type NOT IN {fx.ACCEPTED_SQL} THEN type END, ', '
                          ORDER BY CASE WHEN type IS NULL THEN 'null' WHEN type NOT IN {fx.ACCEPTED_SQL} THEN type END) AS bad
        FROM ({fx.FAULTY_BODIES}) x GROUP BY batch_id)
    SELECT CASE WHEN bad IS NULL THEN 202 ELSE 400 END AS http_status,
           CASE WHEN bad IS NOT NULL THEN concat('Unsupported event type(s): ', bad) END AS message,
           CAST(sum(n_events) AS BIGINT) AS n_events, count(*) AS n_batches
    FROM b GROUP BY 1, 2""",
)
def _(t):
    """Answers to the batches of a stream."""
    verdicts = reported(t, "verdicts").groupBy("http_status", "message")
    return verdicts.agg(F.sum("n_events").alias("n_events"), F.count("*").alias("n_batches"))


@query(
    "stream_backlog",
    f"""WITH a AS (SELECT event_type AS flow_id, count(*) AS n FROM events WHERE event_type IN {fx.ACCEPTED_SQL} GROUP BY 1)
    SELECT flow_id, CAST(0 AS BIGINT) AS tick, least(n, 1000) AS accepted, n - least(n, 1000) AS overflow_dropped,
    least(n, 200) AS sent, least(n, 1000) - least(n, 200) AS backlog FROM a""",
)
def _(t):
    """All that is there when the stream starts is one tick."""
    stream = accepted_events(stream_events(t.spark, written_batches(t)), fx.ACCEPTED)
    out = scratch_path(t.spark, "backlog")
    ticks = stream_backlog(stream.withColumn("flow_id", F.col("type")), capacity=1000, max_batch=200)
    running = ticks.writeStream.outputMode("append").option("checkpointLocation", scratch_path(t.spark, "checkpoint"))
    running.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return t.spark.read.parquet(out)
