"""Running values over long ordered sequences, without one task per sequence.

A plain window per key puts a hot key's whole history into one task.  Here each
key's sequence is cut into ranges of its integer position.  Every range is
scanned on its own, the ranges' totals are scanned one level up, and the two
are added.  Positions being integers bounds every window: at most ``2**BITS``
positions per range, at most ``2**BITS`` ranges per range of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 20


@dataclass(frozen=True)
class Running:
    """What to carry along a sequence.

    ``sum``: total of ``value`` (not negative) since the last row where
    ``reset`` holds; that row's own value counts after the reset.
    ``max``: largest ``value``.
    """

    value: Column
    kind: str = "sum"
    reset: Column | None = None


def running_before(
    df: DataFrame,
    keys: list[str],
    position: str,
    running: dict[str, Running],
    tie_break: tuple[str, ...] = (),
    bits: int = BITS,
) -> DataFrame:
    """Add one column per entry of ``running``: its value over the rows of the
    same ``keys`` (not NULL) that come strictly before, 0 or NULL if there are none.

    ``position`` is an integer that orders each key's rows; ``tie_break`` orders
    the few rows that may share one.
    """
    inputs = {}
    for name, r in running.items():
        inputs[f"_v_{name}"] = r.value
        inputs[f"_r_{name}"] = r.reset if r.reset is not None else F.lit(False)
    rows = df.withColumns({**inputs, "_l1": F.shiftright(F.col(position), bits)})

    in_range = _scan(rows, [*keys, "_l1"], [position, *tie_break], running)
    level1 = _totals(rows, in_range, [*keys, "_l1"], running)
    level1 = level1.withColumn("_l2", F.shiftright("_l1", bits))
    in_level1 = _scan(level1, [*keys, "_l2"], ["_l1"], running)
    level2 = _totals(level1, in_level1, [*keys, "_l2"], running)
    in_level2 = _scan(level2, keys, ["_l2"], running)

    before_range = _add(in_level1, in_level2, [*keys, "_l2"], running)
    result = _add(in_range, before_range, [*keys, "_l1"], running)
    values = [F.col(f"_p_{name}").alias(name) for name in running]
    return result.select(*df.columns, *values)


def _scan(df: DataFrame, part: list[str], order: list[str], running: dict[str, Running]) -> DataFrame:
    """Running values over earlier rows of the same ``part`` (``_p_``), and
    whether one of those rows reset them (``_s_``)."""
    w = Window.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for name, r in running.items():
        v, reset = F.col(f"_v_{name}"), F.col(f"_r_{name}")
        if r.kind == "max":
            out = out.withColumn(f"_p_{name}", F.max(v).over(before))
        elif r.reset is None:
            out = out.withColumn(f"_p_{name}", F.coalesce(F.sum(v).over(before), F.lit(0)))
        else:
            # _m_ is what a reset takes away: all that was added before it.
            # Totals only grow, so the largest one seen is the latest.
            out = out.withColumn(f"_t_{name}", F.sum(v).over(upto))
            out = out.withColumn(f"_m_{name}", F.when(reset, F.col(f"_t_{name}") - v))
            taken = F.coalesce(F.max(f"_m_{name}").over(before), F.lit(0))
            out = out.withColumn(f"_p_{name}", F.col(f"_t_{name}") - v - taken)
            out = out.withColumn(f"_s_{name}", F.coalesce(F.max(reset).over(before), F.lit(False)))
    return out


def _totals(rows: DataFrame, scanned: DataFrame, part: list[str], running: dict[str, Running]) -> DataFrame:
    """One row per ``part`` that acts on a running value as all its rows do.

    Only resets need the scanned rows; without them the totals come straight
    from the input, combined before the shuffle."""
    aggs = []
    for name, r in running.items():
        v, reset = f"_v_{name}", f"_r_{name}"
        if r.kind == "max":
            aggs.append(F.max(v).alias(v))
        elif r.reset is None:
            aggs.append(F.sum(v).alias(v))
        else:
            aggs.append((F.sum(v) - F.coalesce(F.max(f"_m_{name}"), F.lit(0))).alias(v))
        aggs.append(F.max(reset).alias(reset))
    source = scanned if any(r.reset is not None for r in running.values()) else rows
    return source.groupBy(*part).agg(*aggs)


def _add(inner: DataFrame, outer: DataFrame, part: list[str], running: dict[str, Running]) -> DataFrame:
    """Put the value carried into each ``part`` on top of the value within it."""
    carried = outer.select(*part, *[F.col(f"_p_{name}").alias(f"_q_{name}") for name in running])
    out = inner.join(carried, part, "left")
    for name, r in running.items():
        p, q = F.col(f"_p_{name}"), F.col(f"_q_{name}")
        if r.kind == "max":
            both = F.greatest(p, q)
        elif r.reset is None:
            both = p + F.coalesce(q, F.lit(0))
        else:
            both = F.when(F.col(f"_s_{name}"), p).otherwise(p + F.coalesce(q, F.lit(0)))
        out = out.withColumn(f"_p_{name}", both)
    return out.drop(*[f"_q_{name}" for name in running])
