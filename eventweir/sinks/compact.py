"""Rewriting combined objects from their parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.functions.transfer import concatenate
from eventweir.operators.combine import object_problem
from eventweir.session import settings, written_table

TASK_BYTES = 512 * 1024 * 1024
# Opening and closing an object takes as long as copying so many bytes.
OBJECT_COST = 4 * 1024 * 1024


def compact(worklist: DataFrame, stop_on_error: bool = False, name: str = "compact") -> DataFrame:
    """Write each combined object of a worklist; returns ``location, size, status, message``.

    Parts are joined as bytes in manifest order: compressed line files can be
    put end to end, which costs no decoding and makes the result exactly as
    large as its parts, so the next pass sees that it is done.  An object is
    one task's work; it is not much larger than the target size.  A failing
    object does not stop the others unless ``stop_on_error``.  Objects that mix
    size classes or codecs fail before a byte is copied.  Rows with a lower
    ``rank``, if there is one, go first.  The work is done when this returns.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [_rewrite_one(row, stop_on_error) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame(done, columns=["location", "size", "status", "message"])

    if "rank" not in worklist.columns:
        worklist = worklist.withColumn("rank", F.lit(0))
    problem = object_problem(F.col("location"), F.col("source_parts"))
    work = worklist.select("rank", "location", "size", F.col("source_parts.location").alias("sources"), problem.alias("problem"))
    work = written_table(work, name)
    # Rows are short but stand for much work, so the number of tasks follows the
    # bytes to copy.  Tasks start in order: low ranks, the urgent types, first.
    count, cost = work.agg(F.count("*"), F.sum(F.col("size") + OBJECT_COST)).first()
    least = min(count, work.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, least, -(-int(cost or 0) // TASK_BYTES))
    spread = work.repartitionByRange(tasks, "rank", F.xxhash64("location"))
    result = spread.mapInPandas(rewrite, "location string, size bigint, status string, message string")
    # A row names all parts of an object, so a task takes few rows at a time.
    with settings(work.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        return written_table(result, f"{name}-result")


def _rewrite_one(row, stop_on_error: bool) -> tuple:
    try:
        if row.problem is not None:
            raise ValueError(row.problem)
        size = concatenate(list(row.sources), row.location)
        if size != row.size:
            raise OSError(f"{size} bytes written, {row.size} expected")
        return row.location, size, "combined", None
    except Exception as error:
        if stop_on_error:
            raise
        return row.location, None, "failed", str(error)
