"""One pass of compaction over a staging area."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.locations import DEFAULT_TARGET, priority_class
from eventweir.operators import combine as ops
from eventweir.operators.packing import pack_first_fit
from eventweir.schema import GROUP
from eventweir.session import written_table
from eventweir.sinks.compact import compact
from eventweir.sinks.manifests import claim_groups, pass_name, write_manifest, write_snapshot
from eventweir.sources.listing import event_types, list_objects, with_bucket
from eventweir.sources.manifests import explode_parts, group_headers, manifest_view, read_headers, read_manifests


@dataclass
class CombineConfig:
    staging_root: str
    target_root: str
    manifest_root: str
    node: str = "node"
    group_id: str = "group"
    target_size: int = DEFAULT_TARGET
    start_days_ago: int = ops.START_DAYS_AGO
    end_days_ago: int = ops.END_DAYS_AGO
    no_date_limit: bool = False
    suffix: str | None = None  # that of the parts
    stop_on_error: bool = False
    high_priority: list[str] = field(default_factory=list)
    low_priority: list[str] = field(default_factory=list)
    snapshot_every: int = 16


@dataclass
class CombinePass:
    """What a pass did: files placed, objects rewritten (``log``), and groups
    whose manifest does not match the staged files."""

    placed: DataFrame
    log: DataFrame
    bad_manifests: DataFrame


def place_new_files(
    staged: DataFrame,
    manifest: DataFrame,
    node: str,
    now_ms: int,
    target_size: int = DEFAULT_TARGET,
    status: DataFrame | None = None,
) -> DataFrame:
    """Place the files that are in no combined object yet, in groups this node may update.

    ``status`` is that of the manifest's parts, if it is known already."""
    headers = group_headers(manifest)
    status = ops.parts_status(manifest, staged) if status is None else status
    fresh = ops.uncombined_objects(staged, explode_parts(manifest))
    fresh = ops.in_writable_groups(fresh, headers, node, now_ms)
    growable = ops.open_objects(status, target_size)
    numbers = headers.select(*GROUP, F.col("n_objects").alias("next_ordinal"))
    return pack_first_fit(fresh, growable, numbers, target_size)


def run_combine(
    spark: SparkSession,
    config: CombineConfig,
    as_of: dt.datetime,
    types: list[str] | None = None,
    announce: Callable[[DataFrame], None] | None = None,
) -> CombinePass:
    """List, plan, commit the manifest, rewrite what is missing or stale.

    Covers all types, or only ``types``.  Run it again after a pass ends, from
    any scheduler: a pass that finds nothing new changes nothing, and one that
    died is made good by the next.  ``announce`` gets one event per type.
    """
    as_of = as_of.replace(tzinfo=as_of.tzinfo or dt.timezone.utc).astimezone(dt.timezone.utc)
    now_ms = int(as_of.timestamp() * 1000)
    days = None if config.no_date_limit else window_days(as_of.date(), config.start_days_ago, config.end_days_ago)

    def only(df: DataFrame) -> DataFrame:
        return df if types is None else df.where(F.col("event_type").isin(types))

    found = ops.with_size_class(only(with_bucket(list_objects(spark, config.staging_root, days, types=types))))
    # The listing is what the whole pass works from; list once.
    staged = written_table(found.select(*GROUP, "location", "etag", "size", "last_modified"), "staged")
    window = (days[0], _day_after(days[-1])) if days else None

    # So is the manifest: read and folded once, and later reads take the columns they need.
    manifest = written_table(only(read_manifests(spark, config.manifest_root, window)), "manifest")
    status = written_table(ops.parts_status(manifest, staged), "parts-status")
    target_root = config.target_root.rstrip("/")
    placed = written_table(place_new_files(staged, manifest, config.node, now_ms, config.target_size, status), "placed")
    bad = ops.bad_manifests(status, placed, config.target_size)
    bad = written_table(bad, "bad-manifests")
    planned = ops.next_manifest(manifest, placed, target_root, config.node, now_ms, config.suffix)
    # Only objects that got new parts are stored; the others already are.
    touched = placed.select(*GROUP, "ordinal").distinct()
    if not touched.isEmpty():
        changed = planned.join(touched, [*GROUP, "ordinal"], "left_semi")
        # Groups somebody else has stored since they were read wait for the next pass.
        read = group_headers(manifest).select(*GROUP, F.col("version").alias("read_version"))
        proposed = changed.select(*GROUP, "location_prefix").distinct().join(read, GROUP, "left")
        proposed = proposed.withColumn("read_version", F.coalesce("read_version", F.lit(0).cast("bigint")))
        stored = read_headers(spark, config.manifest_root, window)
        free = ops.manifest_conflicts(stored, proposed).where("status = 'commit'")
        name = pass_name(now_ms)
        claims = claim_groups(free, config.manifest_root, name, now_ms)
        ours = claims.where("status = 'commit'")
        if not ours.isEmpty():
            write_manifest(changed.join(ours.select(*GROUP), GROUP, "left_semi"), config.manifest_root, name)
            if len(manifest_view(spark, config.manifest_root).tail) >= config.snapshot_every:
                write_snapshot(spark, config.manifest_root, name)
        manifest = written_table(only(read_manifests(spark, config.manifest_root, window)), "manifest")

    manifest = ops.in_writable_groups(manifest, group_headers(manifest), config.node, now_ms)
    work = ops.combine_worklist(manifest, staged, list_objects(spark, target_root, days, types=types))
    priority = priority_class(F.col("event_type"), config.high_priority, config.low_priority)
    rank = F.when(priority == "high", 0).when(priority == "low", 2).otherwise(1)
    log = compact(work.withColumn("rank", rank), config.stop_on_error)
    if announce is not None:
        names = [t for t in event_types(config.staging_root) if types is None or t in types]
        # Folder names escape special characters as %XX.
        kinds = spark.createDataFrame([(unquote(n),) for n in names], "event_type string")
        announce(ops.combine_completed(kinds, config.group_id, F.lit(as_of)))
    return CombinePass(placed, log, bad)


def window_days(as_of: dt.date, start_days_ago: int, end_days_ago: int) -> list[str]:
    first, beyond = (dt.date.fromisoformat(d) for d in ops.window_bounds(as_of, start_days_ago, end_days_ago))
    return [(first + dt.timedelta(days=n)).isoformat() for n in range((beyond - first).days)]


def _day_after(day: str) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=1)).isoformat()
