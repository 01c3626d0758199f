"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not only speed.
RESULT_SETTINGS = {
    # Buckets are UTC days and hours.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key keeps its last value, as in from_json.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# AQE sizes the shuffles, splits skewed join sides and rebalanced partitions.
SPEED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def use_settings(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    # Folders are listed by jobs of up to this many tasks; one for each folder, as by default, costs more than the listing.
    listing = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)}
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS, **listing}.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the actions inside the block; ``__`` stands for a dot."""
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    A machine-local folder would lose data with its machine, so on a cluster
    the setting is required.  Only a local session without it, as in tests, gets
    a folder of its own, kept under ``eventweir.shared.dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("eventweir.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="eventweir-")
        spark.conf.set("eventweir.shared.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/eventweir/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and pins non-deterministic columns (partition ids,
    generated row ids): a lost executor re-reads files instead of recomputing
    something that could come out differently.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one with all that was written to it."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"not below the shared folder: {path}")
    delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
