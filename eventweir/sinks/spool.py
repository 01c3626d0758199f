"""Writing events as compressed lines, bucketed by type, UTC day and UTC hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.envelope import event_line, event_partition
from eventweir.operators.ingest import file_numbers
from eventweir.schema import BUCKET
from eventweir.session import settings, written_table

DEFAULT_CODEC = "snappy"


def spool_lines(df: DataFrame, *others: str) -> DataFrame:
    """Bucket columns and the line of each event.  An event without a type or a
    timestamp belongs to no bucket and is an error."""
    nowhere = F.raise_error(F.lit("an event without type or timestamp has no bucket"))
    df = df.withColumn("type", F.when(F.col("type").isNull() | F.col("timestamp").isNull(), nowhere).otherwise(F.col("type")))
    return event_partition(df).select(F.col("type").alias("event_type"), "date", "hour", event_line().alias("value"), *others)


def write_spool(
    df: DataFrame,
    root: str,
    max_records: int = 0,
    codec: str = DEFAULT_CODEC,
    batch_id: int | None = None,
    target_bytes: int = 0,
    position: str | None = None,
) -> None:
    """Write events below ``root`` as ``event_type=/date=/hour=`` line files.

    Buckets are brought together first, so each is written by one task, with
    few files.  The shuffle is a rebalance: a bucket much larger than the others
    is split over as many tasks as its size asks for.  ``max_records`` rolls
    files earlier.  With ``batch_id`` the files go to a folder of that batch,
    which a repeated run of the batch replaces.

    ``target_bytes`` rolls files by the bytes of their lines, see ``file_numbers``:
    each is a ``file=`` folder's only one, its lines in the order of the integer
    column ``position`` (or else as they came), a hot bucket cut into as many as
    its size asks for.
    """
    partitions = list(BUCKET)
    if target_bytes:
        numbered = spool_lines(df.withColumn("_position", F.col(position) if position else F.monotonically_increasing_id()), "_position")
        # Generated positions are pinned by storing them.
        numbered = file_numbers(written_table(numbered, "spool-lines"), target_bytes, BUCKET, "_position", "value")
        partitions.append("file")
        # By hash, not a rebalance: that might cut a file in two.
        lines = numbered.repartition(*partitions).sortWithinPartitions(*partitions, "_position")
        lines = lines.select(*BUCKET, F.lpad(F.col("file").cast("string"), 6, "0").alias("file"), "value")
    else:
        lines = spool_lines(df).hint("rebalance", *BUCKET)
    if batch_id is not None:
        lines = lines.withColumn("batch", F.lit(f"{batch_id:09d}"))
        partitions.append("batch")
    writer = lines.write.partitionBy(*partitions).option("compression", codec).option("maxRecordsPerFile", max_records)
    if batch_id is None:
        writer = writer.mode("append")
    else:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    # Opening files costs more than filling small ones: use all tasks even for little data.
    with settings(df.sparkSession, spark__sql__adaptive__coalescePartitions__minPartitionSize="16k"):
        writer.text(root)


def read_spool_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with their bucket; bucket columns are text (``00`` is not a number)."""
    return spark.read.schema("value string, event_type string, date string, hour string").text(root)
