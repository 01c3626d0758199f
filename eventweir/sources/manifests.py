"""Reading manifests: which staged files went into which combined object."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.transfer import read_small
from eventweir.schema import GROUP, GROUP_DOCUMENT, MANIFEST

#: Below the manifest's root: the names of the passes that each snapshot holds.
FOLDED = "_folded"


@dataclass
class ManifestView:
    """What one look at a manifest's root found: the fullest snapshot, the passes
    it holds, and the folders of finished passes that it does not hold."""

    snapshot: str | None
    folded: list[str]
    tail: list[str]


def manifest_view(spark: SparkSession, root: str) -> ManifestView:
    """One listing of the root, then a look for the markers of the other passes only."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root.rstrip("/"))
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(top)) if system.exists(top) else []

    def finished(name: str) -> bool:
        return system.exists(path(f"{root.rstrip('/')}/{name}/_SUCCESS"))

    snapshots = [name for name in names if name.startswith("snapshot=")]
    fullest = next((name for name in reversed(snapshots) if finished(name)), None)
    folded = json.loads(read_small(f"{root.rstrip('/')}/{FOLDED}/{fullest}")) if fullest else []
    known = {f"pass={name}" for name in folded}
    tail = [name for name in names if name.startswith("pass=") and name not in known and finished(name)]
    return ManifestView(fullest, folded, [f"{root.rstrip('/')}/{name}" for name in tail])


def stored_rows(spark: SparkSession, root: str, view: ManifestView, dates: tuple[str, str] | None = None) -> DataFrame:
    """Manifest rows of a view with the ``pass`` they come from, several versions of an object among them."""
    schema = f"{MANIFEST}, pass string"
    rows = spark.createDataFrame([], schema)
    if view.tail:
        rows = spark.read.schema(schema).option("basePath", root).parquet(*view.tail)
    if view.snapshot:
        folded = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{view.snapshot}")
        rows = folded.unionByName(rows) if view.tail else folded
    return rows.where((F.col("date") >= dates[0]) & (F.col("date") < dates[1])) if dates else rows


def latest_objects(rows: DataFrame) -> DataFrame:
    """Each object at its latest version; of equal versions, which only a writer
    that outlived its claim can leave, the later pass counts."""
    others = [c for c in rows.columns if c not in (*GROUP, "ordinal", "version", "pass")]
    latest = rows.groupBy(*GROUP, "ordinal").agg(
        F.max_by(F.struct("version", "pass", *others), F.struct("version", "pass")).alias("_o")
    )
    return latest.select(*GROUP, "ordinal", "_o.*").select(*rows.columns)


def read_manifests(spark: SparkSession, root: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """Current manifest: one row per combined object, at its latest version.

    Every pass over the data adds a folder with the objects it changed; one that
    was not finished is not read.  Passes that a snapshot holds are not opened.
    ``dates`` (first, beyond last) keeps the scan to that window.  No manifest
    yet means no rows; one that does not parse is an error.
    """
    return latest_objects(stored_rows(spark, root, manifest_view(spark, root), dates)).drop("pass")


def read_headers(spark: SparkSession, root: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """``group_headers`` of the current manifest, from columns of a few bytes; part lists are not read."""
    return group_headers(stored_rows(spark, root, manifest_view(spark, root), dates))


def explode_parts(manifest: DataFrame) -> DataFrame:
    """One row per source part, with its position in the combined object."""
    return manifest.select(
        *GROUP,
        "ordinal",
        F.col("location").alias("object_location"),
        F.posexplode("source_parts").alias("part_no", "_part"),
    ).select(*GROUP, "ordinal", "object_location", "part_no", "_part.*")


def group_headers(manifest: DataFrame) -> DataFrame:
    """Version, writer, time and next free ordinal of each group.  Objects of
    a commit that died may be missing, so the next one comes after the last, not after as many."""
    order = F.struct("version", "pass") if "pass" in manifest.columns else F.col("version")
    newest = F.max_by(F.struct("version", "creator", "updated_ts", "location_prefix"), order)
    return (
        manifest.groupBy(*GROUP)
        .agg(newest.alias("_h"), (F.max("ordinal") + 1).alias("n_objects"))
        .select(*GROUP, "_h.*", "n_objects")
    )


def read_group_documents(spark: SparkSession, path: str) -> DataFrame:
    """Import manifests kept as one JSON document per group, into manifest rows.

    ``path`` holds ``type/date/hour.<size>.metadata`` files.
    """
    documents = (
        spark.read.schema(GROUP_DOCUMENT)
        .options(multiLine=True, mode="FAILFAST", recursiveFileLookup=True, pathGlobFilter="*.metadata")
        .json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    return explode_groups(documents.withColumn("_parts", F.split("_file", "/")))


def explode_groups(documents: DataFrame) -> DataFrame:
    """Manifest rows from group documents with their path segments in ``_parts``."""
    parts = F.col("_parts")
    name = F.split(F.element_at(parts, -1), r"\.")
    part = F.transform(
        "o.sourceParts",
        lambda p: F.struct(p["location"].alias("location"), p["etag"].alias("etag"), p["size"].alias("size"), p["lastModified"].alias("last_modified")),
    )
    return documents.select(
        F.element_at(parts, -3).alias("event_type"),
        F.element_at(parts, -2).alias("date"),
        name[0].alias("hour"),
        name[1].alias("size_class"),
        F.col("locationPrefix").alias("location_prefix"),
        "version",
        "creator",
        F.col("updatedTimestamp").alias("updated_ts"),
        F.posexplode("combinedObjects").alias("ordinal", "o"),
    ).select(
        *GROUP,
        "location_prefix",
        "version",
        "creator",
        "updated_ts",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("o.location").alias("location"),
        F.col("o.updatedTimestamp").alias("object_updated_ts"),
        part.alias("source_parts"),
    )
