"""Accepting, counting and comparing events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.envelope import accept_status, canonical_json
from eventweir.operators.joins import join_small, small_table
from eventweir.operators.running import Running, running_before
from eventweir.schema import ENVELOPE_FIELDS

# Verdict of an event batch.
ALL_ACCEPTED = 202
SOME_UNSUPPORTED = 400
UNSUPPORTED_TYPES = "Unsupported event type(s): "

# Who receives an event, by how it came in: forwarded events are not stored twice.
SINKS = {"write": ["spool", "tap"], "distribute": ["tap"]}


def inbound_counts(df: DataFrame, accepted: Iterable[str], process_type: str = "write") -> DataFrame:
    """Events per (type, valid/unsupported, write/distribute)."""
    return (
        df.groupBy(F.col("type").alias("event_type"), accept_status(F.col("type"), accepted).alias("status"))
        .agg(F.count("*").alias("n_events"))
        .withColumn("process_type", F.lit(process_type))
    )


def batch_verdicts(df: DataFrame, accepted: Iterable[str]) -> DataFrame:
    """Answer to each batch: 202, or 400 naming the distinct unsupported types in order.

    Good events of a bad batch are still processed; this only reports.
    """
    unsupported = accept_status(F.col("type"), accepted) == "unsupported"
    # One row per (batch, bad type) first, so that no batch is gathered event by event.
    bad = F.when(unsupported, F.coalesce("type", F.lit("null")))
    distinct = df.groupBy("batch_id", bad.alias("bad_type")).agg(F.count("*").alias("n"))
    return (
        distinct.groupBy("batch_id")
        .agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list("bad_type")).alias("bad_types"))
        .select(
            "batch_id",
            "n_events",
            F.when(F.size("bad_types") == 0, ALL_ACCEPTED).otherwise(SOME_UNSUPPORTED).alias("http_status"),
            F.when(F.size("bad_types") > 0, F.concat(F.lit(UNSUPPORTED_TYPES), F.array_join("bad_types", ", "))).alias(
                "message"
            ),
        )
    )


def fan_out(df: DataFrame, process_type: str | Column = "write") -> DataFrame:
    """One row per (event, sink)."""
    kind = F.lit(process_type) if isinstance(process_type, str) else process_type
    sinks = F.lit(None)
    for name, targets in SINKS.items():
        sinks = F.when(kind == name, F.array(*[F.lit(t) for t in targets])).otherwise(sinks)
    return df.withColumn("sink", F.explode(sinks))


def spool_counts(df: DataFrame, cleared_at: Column | None = None, received_at: str = "timestamp") -> DataFrame:
    """Events spooled per type since the counts were cleared; types without any are absent.

    Nothing ever counts as lost here: a spooled event is kept until uploaded.
    """
    if cleared_at is not None:
        df = df.where(F.col(received_at) > cleared_at)
    return (
        df.groupBy(F.col("type").alias("event_type"))
        .agg(F.count("*").alias("received"))
        .withColumn("lost", F.lit(0).cast("bigint"))
    )


def diff_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events that occur more often on one side: the five fields, the ``side``
    and by how many times (``n``).  Payloads compare without key order."""

    def signed(df: DataFrame, sign: int) -> DataFrame:
        fields = [F.col(f) for f in ENVELOPE_FIELDS if f != "data"]
        return df.select(*fields, canonical_json(F.col("data")).alias("data"), F.lit(sign).alias("_sign"))

    net = signed(left, 1).unionByName(signed(right, -1)).groupBy(*ENVELOPE_FIELDS).agg(F.sum("_sign").alias("_net"))
    return net.where("_net <> 0").select(
        *ENVELOPE_FIELDS,
        F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"),
        F.abs("_net").alias("n"),
    )


def records_per_file(lines: DataFrame, target_bytes: int, keys: list[str], line: str = "line") -> DataFrame:
    """Roll policy: how many records of each key fill a file of ``target_bytes``.

    The file is rolled by the record that reaches the target, hence rounding up.
    """
    size = F.sum(F.octet_length(F.col(line)) + F.lit(1))
    return (
        lines.groupBy(*keys)
        .agg(F.count("*").alias("records"), size.alias("bytes"))
        .withColumn("records_per_file", F.ceil(F.lit(target_bytes) * F.col("records") / F.col("bytes")))
    )


def file_numbers(lines: DataFrame, target_bytes: int, keys: list[str], position: str, line: str = "line") -> DataFrame:
    """Add ``file``: the lines of each key in order of ``position`` (a unique
    integer), cut into files of about equal size, as few as ``target_bytes`` allows.

    A line belongs to the file in which it begins.  So a file has no more than
    the target and one line, and of a key with several files none has less than
    half the target less one line.  ``lines`` should be stored, as it is read twice.

    A key may hold most lines: their bytes are summed by ranges of positions, and
    its files can be written by as many tasks.
    """
    size = (F.octet_length(F.col(line)) + 1).cast("bigint")
    totals = lines.groupBy(*keys).agg(F.sum(size).alias("_total"))
    n_files = F.ceil(F.col("_total") / F.lit(target_bytes)).cast("bigint")
    share = F.ceil(F.col("_total") / n_files).cast("bigint").alias("_share")
    shares = small_table(totals.select(*keys, share), "file-shares")
    placed = running_before(lines, keys, position, {"_begin": Running(size)})
    placed = join_small(placed, shares, keys, [position])
    return placed.withColumn("file", F.expr("_begin div _share")).drop("_begin", "_share")
