"""Planning which staged files go into which combined object, and what to rewrite."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.locations import DEFAULT_TARGET, combined_location, combined_prefix, location_codec, size_class, suffix_of
from eventweir.schema import GROUP
from eventweir.sources.manifests import explode_parts, group_headers

START_DAYS_AGO = 14
END_DAYS_AGO = -1
WRITER_LEASE_MS = 5 * 60 * 1000


def window_bounds(as_of: dt.date, start_days_ago: int = START_DAYS_AGO, end_days_ago: int = END_DAYS_AGO) -> tuple[str, str]:
    """First day inside and first day beyond the window."""
    if start_days_ago <= end_days_ago:
        raise ValueError("start_days_ago must be greater than end_days_ago")
    first, beyond = (as_of - dt.timedelta(days=d) for d in (start_days_ago, end_days_ago))
    return first.isoformat(), beyond.isoformat()


def date_window(
    df: DataFrame,
    as_of: dt.date,
    start_days_ago: int = START_DAYS_AGO,
    end_days_ago: int = END_DAYS_AGO,
    disabled: bool = False,
) -> DataFrame:
    """Keep buckets of the days in the window.  Days compare as text, on the
    bare column, so that a partitioned table is pruned."""
    first, beyond = window_bounds(as_of, start_days_ago, end_days_ago)
    return df if disabled else df.where((F.col("date") >= first) & (F.col("date") < beyond))


def with_size_class(listing: DataFrame) -> DataFrame:
    """Add ``size_class``; empty files are dropped."""
    return listing.where("size <> 0").withColumn("size_class", size_class(F.col("size")))


def uncombined_objects(staged: DataFrame, parts: DataFrame) -> DataFrame:
    """Staged files whose location is in no combined object of their group."""
    return staged.join(parts.select(*GROUP, "location"), [*GROUP, "location"], "left_anti")


def parts_status(manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """Per combined object: are all its parts still staged, and are they the same files.

    ``size`` and ``n_parts`` are those of the manifest."""
    part = explode_parts(manifest)
    now = staged.select(
        *GROUP, "location", F.col("etag").alias("_etag"), F.col("size").alias("_size"), F.lit(True).alias("_staged")
    )
    there = F.coalesce(F.col("_staged"), F.lit(False))
    same = there & F.col("etag").eqNullSafe(F.col("_etag")) & (F.col("size") == F.col("_size"))
    return (
        part.join(now, [*GROUP, "location"], "left")
        .groupBy(*GROUP, "ordinal")
        .agg(
            F.bool_and(there).alias("all_available"),
            F.bool_and(same).alias("matches"),
            F.sum("size").alias("size"),
            F.count("*").alias("n_parts"),
        )
    )


def bad_manifests(status: DataFrame, new_objects: DataFrame, target: int = DEFAULT_TARGET) -> DataFrame:
    """Groups with files to place that have an object below the target whose
    parts are all there but not the files it was made from."""
    bad = status.where((F.col("size") < target) & F.col("all_available") & ~F.col("matches"))
    return bad.select(*GROUP).distinct().join(new_objects.select(*GROUP).distinct(), GROUP, "left_semi")


def open_objects(status: DataFrame, target: int = DEFAULT_TARGET) -> DataFrame:
    """Combined objects that may still take files."""
    growing = (F.col("size") < target) & F.col("all_available") & F.col("matches")
    return status.where(growing).select(*GROUP, "ordinal", "size", "n_parts")


def writable_groups(headers: DataFrame, node: str, now_ms: int) -> DataFrame:
    """Groups this node may update: it wrote them last, or nobody did for five
    minutes.  Groups without a manifest are free and not listed here."""
    return headers.where((F.col("creator") == node) | (F.lit(now_ms) - F.col("updated_ts") >= WRITER_LEASE_MS))


def in_writable_groups(df: DataFrame, headers: DataFrame, node: str, now_ms: int) -> DataFrame:
    """Rows of groups that are writable or have no manifest yet."""
    writable = writable_groups(headers, node, now_ms)
    locked = headers.select(*GROUP).join(writable.select(*GROUP), GROUP, "left_anti")
    return df.join(locked, GROUP, "left_anti")


def next_manifest(
    manifest: DataFrame, placed: DataFrame, target_root: str, node: str, now_ms: int, suffix: str | None = "json.snappy"
) -> DataFrame:
    """The manifest after the placements of ``pack_first_fit``.

    Every added part is one update of its group: it raises the version by one.
    Groups without new parts stay as they are.  A combined object's parts are
    gathered in one row; an object is closed at the target size, a group is not.
    Without a ``suffix`` a new object's is that of its first part.
    """
    part = F.struct("part_no", "location", "etag", "size", "last_modified")
    stripped = F.transform(
        F.array_sort("_new"),
        lambda p: F.struct(p["location"].alias("location"), p["etag"].alias("etag"), p["size"].alias("size"), p["last_modified"].alias("last_modified")),
    )
    added = placed.groupBy(*GROUP, "ordinal").agg(F.collect_list(part).alias("_new"), F.count("*").alias("_added"))
    updates = added.groupBy(*GROUP).agg(F.sum("_added").alias("_updates"))
    headers = group_headers(manifest).select(*GROUP, F.col("version").alias("_version"), F.col("creator").alias("_creator"), F.col("updated_ts").alias("_updated_ts"))
    groups = headers.join(updates, GROUP, "full_outer")

    objects = manifest.select(*GROUP, "ordinal", "location", "object_updated_ts", "source_parts")
    joined = objects.join(added, [*GROUP, "ordinal"], "full_outer").join(groups, GROUP, "left")
    joined = joined.withColumn("_sorted", stripped)
    changed, touched = F.col("_updates").isNotNull(), F.col("_added").isNotNull()
    prefix = combined_prefix(target_root, F.col("size_class"))
    none = F.array().cast(manifest.schema["source_parts"].dataType)
    return joined.select(
        *GROUP,
        prefix.alias("location_prefix"),
        (F.coalesce("_version", F.lit(0)) + F.coalesce("_updates", F.lit(0))).cast("bigint").alias("version"),
        F.when(changed, F.lit(node)).otherwise(F.col("_creator")).alias("creator"),
        F.when(changed, F.lit(now_ms)).otherwise(F.col("_updated_ts")).cast("bigint").alias("updated_ts"),
        "ordinal",
        F.coalesce("location", combined_location(prefix, F.col("ordinal"), suffix or suffix_of(F.get("_sorted", F.lit(0))["location"]))).alias("location"),
        F.when(touched, F.lit(now_ms)).otherwise(F.col("object_updated_ts")).cast("bigint").alias("object_updated_ts"),
        F.concat(F.coalesce("source_parts", none), F.coalesce("_sorted", none)).alias("source_parts"),
    )


def manifest_conflicts(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """May each proposed group (``read_version``, ``location_prefix``) replace the stored one.

    ``conflict``: somebody stored another version since it was read, or nothing
    is stored although a version was read.  A changed location prefix is an error.
    """
    stored = stored.select(*GROUP, F.col("version").alias("stored_version"), F.col("location_prefix").alias("_prefix"))
    moved = F.col("_prefix") != F.col("location_prefix")
    same = F.coalesce(F.col("stored_version"), F.lit(0)) == F.col("read_version")
    status = (
        F.when(moved, F.raise_error(F.concat(F.lit("location prefix changed: "), F.col("location_prefix"))))
        .when(same, "commit")
        .otherwise("conflict")
    )
    return proposed.join(stored, GROUP, "left").select(*GROUP, "read_version", "stored_version", status.alias("status"))


def combine_worklist(manifest: DataFrame, staged: DataFrame, targets: DataFrame) -> DataFrame:
    """Combined objects to (re)write: all parts are staged, and the target is
    missing or not as large as its parts together."""
    status = parts_status(manifest, staged).where("all_available").select(*GROUP, "ordinal", "size", "n_parts")
    existing = targets.select("location", F.col("size").alias("target_size"))
    work = manifest.select(*GROUP, "ordinal", "location", "source_parts").join(status, [*GROUP, "ordinal"])
    work = work.join(existing, "location", "left")
    stale = F.col("target_size").isNull() | (F.col("target_size") != F.col("size"))
    return work.where(stale).select(*GROUP, "ordinal", "location", "size", "n_parts", "target_size", "source_parts")


def is_mixed(source_parts: Column) -> Column:
    """Are there small and large files among the parts of an object."""
    return F.size(F.array_distinct(F.transform(source_parts, lambda p: size_class(p["size"])))) > 1


def mixed_objects(manifest: DataFrame) -> DataFrame:
    """Combined objects made of both small and large files, which must not be."""
    return manifest.where(is_mixed(F.col("source_parts"))).select(*GROUP, "ordinal")


def object_problem(location: Column, source_parts: Column) -> Column:
    """Why a combined object must not be made of its parts; NULL if it may be.

    Small and large files are not mixed, and files can only be put end to end
    if they and the object have the same codec."""
    codecs = F.array_distinct(F.transform(source_parts, lambda p: location_codec(p["location"])))
    named = F.array_sort(F.transform(codecs, lambda c: F.when(c == "", "none").otherwise(c)))
    return (
        F.when(is_mixed(source_parts), "small and large files in one object")
        .when(F.size(codecs) > 1, F.concat(F.lit("several codecs: "), F.array_join(named, ", ")))
        .when(F.get(codecs, F.lit(0)) != location_codec(location), "the parts have another codec than the object")
    )


def combine_completed(types: DataFrame, group_id: str, at: Column) -> DataFrame:
    """One event per type and pass, whether or not anything changed.  It goes
    the way of all events but does not have to be on the accept list."""
    kind = F.col("event_type")
    return types.select("event_type").distinct().select(
        F.lit("CombineCompleted").alias("type"),
        F.md5(F.concat_ws("/", F.lit(group_id), kind, at.cast("string"))).alias("uuid"),
        F.lit(group_id).alias("host"),
        at.cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(F.lit(group_id).alias("groupId"), kind.alias("eventType"))).alias("data"),
    )
