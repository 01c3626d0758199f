"""Staged event files: are they whole, where do they belong, what became of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.envelope import one_json_value, utc_date, utc_hour
from eventweir.functions.inspection import inspect_file
from eventweir.functions.transfer import move_into
from eventweir.schema import ENVELOPE_TEXT
from eventweir.session import written_table
from eventweir.sources.events import with_instant
from eventweir.sources.listing import list_objects

UNKNOWN_TYPE = "unknown"
RETRY_PERIOD = 300


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below ``path``: ``file``, ``line_no`` (increasing, not
    dense) and ``value``.  For files known to be whole, see ``verify_files``."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    # A file that can be split has its blocks in order of their start.
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        "value",
    )


def file_verdicts(lines: DataFrame) -> DataFrame:
    """Per file (``file, value``): records, and whether every line that is not
    blank is one JSON value."""
    blank = F.trim("value") == ""
    judged = lines.select("file", blank.alias("blank"), (blank | one_json_value(F.col("value"))).alias("json"))
    return judged.groupBy("file").agg(F.count_if(~F.col("blank")).alias("n_records"), F.bool_and("json").alias("all_json"))


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """``verify_listing`` of every file below ``path``."""
    return verify_listing(list_objects(spark, path).select(F.col("location").alias("file"), "size"))


def verify_listing(listing: DataFrame) -> DataFrame:
    """``file, size, n_records, first_type, date, hour, status`` of files (``file, size``).

    A file is ``ok`` when all of it decompresses and parses and its first line
    is an event with a type and a time; otherwise the whole file is
    ``corrupt``.  The first line tells the bucket of a file left over from an
    earlier run.  Expects records that do not span lines.

    Tasks open the files themselves: Spark's readers believe the sizes that
    broken compressed files name, and fail the job.
    """

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [inspect_file(f) for f in pdf["file"]]
            yield pdf.assign(
                whole=[f[0] for f in found], n_records=[f[1] for f in found], first_line=[f[2] for f in found]
            )

    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, 1)
    inspected = listing.repartition(tasks * 4, "file").mapInPandas(
        inspect, "file string, size bigint, whole boolean, n_records bigint, first_line string"
    )
    event = with_instant(inspected.select("*", F.from_json("first_line", ENVELOPE_TEXT).alias("_e")).select("*", "_e.*"))
    ok = F.col("whole") & F.col("type").isNotNull() & F.col("timestamp").isNotNull()
    ts = F.col("timestamp")
    return event.select(
        "file", "size", "n_records", F.col("type").alias("first_type"), utc_date(ts).alias("date"), utc_hour(ts).alias("hour"),
        F.when(ok, "ok").otherwise("corrupt").alias("status"),
    )


def file_partition(lines: DataFrame) -> DataFrame:
    """Bucket of each file, taken from its first event (``file, line_no, type, timestamp``)."""
    ts = F.col("_first.timestamp")
    return (
        lines.groupBy("file")
        .agg(F.min(F.struct("line_no", "type", "timestamp")).alias("_first"))
        .select(
            "file",
            F.col("_first.type").alias("event_type"),
            utc_date(ts).alias("date"),
            utc_hour(ts).alias("hour"),
        )
    )


def quarantine_corrupt(verdicts: DataFrame, failed_root: str) -> DataFrame:
    """Move corrupt files to ``failed_root``; returns where they went.  The move
    is done when this returns; the files are not looked at again.  Files of
    several folders may share a name, so the new name starts with a digest of
    the old location."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(moved_to=[move_into(f, failed_root) for f in pdf["file"]])

    bad = verdicts.where("status = 'corrupt'").select("file")
    tasks = max(bad.sparkSession.sparkContext.defaultParallelism, 1)
    return written_table(bad.repartition(tasks, "file").mapInPandas(move, "file string, moved_to string"), "quarantine")


def upload_stats(file_log: DataFrame) -> DataFrame:
    """Counters over upload attempts (``file, attempt, outcome, event_type, duration_ms``).

    ``processed_files``: uploaded per type; corrupt ones have no known type.
    ``upload_attempts``: per type and success or failure.
    ``processed_time``: attempts and their time per type, whatever came out;
    corrupt files never get as far as an attempt.
    """
    # Counted per type and outcome first; only those few rows become entries.
    counted = file_log.groupBy("event_type", "outcome").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    outcome, event_type = F.col("outcome"), F.col("event_type")

    def entry(metric: str, key: Column, status: Column, ms: Column = F.lit(None)) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            key.alias("event_type"),
            status.cast("string").alias("status"),
            F.col("n").alias("n"),
            ms.cast("bigint").alias("ms"),
        )

    entries = F.when(
        outcome == "corrupt", F.array(entry("processed_files", F.lit(UNKNOWN_TYPE), F.lit("corrupt")))
    ).otherwise(
        F.array_compact(
            F.array(
                F.when(outcome == "success", entry("processed_files", event_type, F.lit("uploaded"))),
                entry("upload_attempts", event_type, outcome),
                entry("processed_time", event_type, F.lit(None), F.col("ms")),
            )
        )
    )
    return (
        counted.select(F.explode(entries).alias("e"))
        .groupBy("e.metric", "e.event_type", "e.status")
        .agg(F.sum("e.n").alias("n"), F.sum("e.ms").alias("total_ms"))
    )


LEDGER_STATE = {"success": "uploaded", "corrupt": "failed", "failure": "retry"}


def retry_ledger(file_log: DataFrame, as_of: Column, period: int = RETRY_PERIOD) -> DataFrame:
    """Where each file stands after its latest attempt.  Files to retry are due
    one period after it, again and again without limit."""
    state = F.lit(None)
    for outcome, name in LEDGER_STATE.items():
        state = F.when(F.col("_last.outcome") == outcome, name).otherwise(state)
    due = F.when(F.col("state") == "retry", F.col("last_finished_at") + F.lit(period))
    return (
        file_log.groupBy("file")
        .agg(F.max(F.struct("attempt", "outcome", "finished_at")).alias("_last"), F.count("*").alias("attempts"))
        .select("file", state.alias("state"), "attempts", F.col("_last.finished_at").alias("last_finished_at"))
        .withColumn("due_at", due)
        .withColumn("is_due", F.coalesce(F.col("due_at") <= as_of, F.lit(False)))
    )
