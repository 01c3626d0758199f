"""FIFO batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.operators.running import Running, running_before

MAX_BATCH = 1000


def batch_numbers(df: DataFrame, keys: list[str], seq: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """FIFO batches per key: adds ``batch_id`` and the position in the batch, ``pos``.

    ``seq`` is the integer arrival number."""
    counted = running_before(df, keys, seq, {"_earlier": Running(F.lit(1).cast("bigint"))})
    return counted.withColumns(
        {
            "batch_id": F.floor(F.col("_earlier") / max_batch).cast("bigint"),
            "pos": F.pmod(F.col("_earlier"), F.lit(max_batch)).cast("bigint"),
        }
    ).drop("_earlier")
