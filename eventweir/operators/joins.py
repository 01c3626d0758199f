"""Joins of a large side with a side that is expected to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.session import written_table

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a table by its JSON text; an upper bound in practice, computed on the executors."""
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(32))).first()[0]
    return int(total or 0)


def small_table(df: DataFrame, name: str) -> DataFrame:
    """Store a table that is expected to be small, so that measuring and joining
    it does not compute it again."""
    return written_table(df, name)


def join_small(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = 64,
) -> DataFrame:
    """Join on ``keys`` without moving ``large`` when ``small`` is measured to fit.

    A few hot keys may hold most of ``large``, so beyond ``max_bytes`` each key
    is spread over ``salts`` shuffle keys by a hash of ``spread_by`` and
    ``small`` is repeated once per salt.  Both ways give the same rows.
    ``small`` should be a stored table, see ``small_table``.
    """
    if measured_bytes(small) <= max_bytes:
        return large.join(F.broadcast(small), keys, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    return salted.join(small.withColumn("_salt", F.explode(every_salt)), [*keys, "_salt"], how).drop("_salt")
