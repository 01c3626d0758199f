"""First-fit packing of files into combined objects.

A group's files are taken in location order.  Each goes to the first combined
object below the target size that may still grow, else to a new one.  An
object is closed once it reaches the target, so objects fill one after the
other and the packing is a walk: state ``(object, bytes, parts)``, one step per
file.

One group may hold a large share of all files, so the walk is not done in one
task.  The files are range-partitioned by (group, location) into chunks.  For
every chunk of a group that spans several chunks, a task works out where the
walk leaves the chunk for each way it may enter; that needs no more numbers
than the files that fill one object.  A second step walks over the chunks, and
a third assigns the files of each chunk from its now known entry state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweir.functions.locations import DEFAULT_TARGET
from eventweir.schema import GROUP
from eventweir.session import written_table

#: Files a task holds in Python, about 1 kB each with their copies; fewer than LEAST_FILES are not spread.
CHUNK_FILES = 100_000
LEAST_FILES = 10_000

CELL = [*GROUP, "_chunk"]
STATE = [*CELL, "_open", "_next", "_acc", "_parts"]
_ENTRY = ["_e_open", "_e_next", "_e_acc", "_e_parts"]
_OPEN = "array<struct<ordinal: bigint, size: bigint, n_parts: bigint>>"
_GROUP_TYPES = ", ".join(f"{c} string" for c in GROUP)


def pack_first_fit(
    new_objects: DataFrame,
    open_objects: DataFrame | None = None,
    next_ordinals: DataFrame | None = None,
    target: int = DEFAULT_TARGET,
    chunks: int | None = None,
) -> DataFrame:
    """Place files (group columns, ``location, etag, size, last_modified``).

    ``open_objects``: existing combined objects that may grow (group columns,
    ``ordinal, size, n_parts``).  ``next_ordinals``: per group the number of
    combined objects it has (``next_ordinal``).  Adds ``ordinal`` and
    ``part_no``, the file's position within its combined object.
    ``chunks`` fixes the number of ranges; by default it follows the number of
    files, so that a task holds a bounded number whatever the session's settings.
    """
    files = new_objects.select(*GROUP, "location", "etag", "size", "last_modified")
    by = [*GROUP, "location"]
    if chunks is None:
        # Stored: counting, sampling the bounds and dealing out read it each.
        files = written_table(files, "files")
        chunks = _chunk_count(files.count(), files.sparkSession.sparkContext.defaultParallelism)
    ordered = files.repartitionByRange(chunks, *by).sortWithinPartitions(*by).withColumn("_chunk", F.spark_partition_id())
    # Range bounds are sampled per run; writing pins each file to one chunk.
    ordered = written_table(ordered, "pack")

    cells = ordered.groupBy(*CELL).agg(F.sum("size").alias("_bytes"), F.max("size").alias("_largest"))
    # A row per group and chunk; stored, since what they take from the manifest
    # costs joins over all its parts.
    cells = written_table(_with_manifest_state(cells, open_objects, next_ordinals, target), "cells")
    if cells.agg(F.max("_chunk") > F.min("_chunk")).first()[0]:
        cells = _with_entries(ordered, cells, target)

    def assign(files: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        return _assign_chunk(files, cells, target)

    placed = (
        ordered.groupBy("_chunk")
        # toDF: both sides come from one table, fresh columns tell them apart.
        .cogroup(cells.select(*STATE).toDF(*STATE).groupBy("_chunk"))
        .applyInPandas(
            assign,
            f"{_GROUP_TYPES}, location string, etag string, size bigint, "
            "last_modified bigint, ordinal bigint, part_no bigint",
        )
    )
    return placed


def _chunk_count(files: int, parallelism: int) -> int:
    """Chunks of at most ``CHUNK_FILES`` on average, and of few files only to use all cores."""
    return max(1, -(-files // CHUNK_FILES), min(parallelism, -(-files // LEAST_FILES)))


def _with_manifest_state(cells: DataFrame, open_objects, next_ordinals, target: int) -> DataFrame:
    """Add what the manifest says about each group: the state the walk starts
    from, the next ordinal, and on the group's first chunk its growable objects
    (there may be many, so not on every chunk)."""
    none = F.expr(f"CAST(array() AS {_OPEN})")
    zero = F.lit(0).cast("bigint")
    if open_objects is None:
        cells = cells.withColumns({"_all_open": none})
    else:
        entry = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "size", "n_parts")])
        per_group = open_objects.groupBy(*GROUP).agg(F.array_sort(F.collect_list(entry)).alias("_all_open"))
        cells = cells.join(per_group, GROUP, "left").withColumn("_all_open", F.coalesce("_all_open", none))
    if next_ordinals is None:
        cells = cells.withColumn("_next", zero)
    else:
        known = next_ordinals.select(*GROUP, F.col("next_ordinal").cast("bigint").alias("_next"))
        cells = cells.join(known, GROUP, "left").withColumn("_next", F.coalesce("_next", zero))
    first = F.try_element_at("_all_open", F.lit(1))
    # All but the last growable object are followed by one that is not empty.
    not_last = F.slice("_all_open", F.lit(1), F.greatest(F.size("_all_open") - 1, F.lit(0)))
    is_first = F.col("_chunk") == F.min("_chunk").over(Window.partitionBy(*GROUP))
    return cells.withColumns(
        {
            "_open": F.when(is_first, F.col("_all_open")).otherwise(none),
            "_room": F.aggregate(not_last, zero, lambda s, o: s + F.lit(target) - o["size"]),
            "_before_last": F.size(not_last),
            "_acc": F.coalesce(first["size"], zero),
            "_parts": F.coalesce(first["n_parts"], zero),
        }
    ).drop("_all_open")


def _with_entries(ordered: DataFrame, cells: DataFrame, target: int) -> DataFrame:
    """Replace the start state by the state at which the walk enters each chunk."""
    group = Window.partitionBy(*GROUP)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    spanning = cells.withColumn("_n", F.count("*").over(group)).where("_n > 1")
    # Growable objects but the last take in no more than their room and one file
    # each beyond it, so only chunks that start before that need all prefix sums.
    reach = F.col("_room") + F.col("_before_last") * F.max("_largest").over(group)
    spanning = spanning.withColumn("_full", F.coalesce(F.sum("_bytes").over(before), F.lit(0)) < reach)
    spanning = spanning.select(*CELL, "_full", "_open", "_next", "_acc", "_parts")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("location")
        known, closed, acc, parts = _chunk_exits(pdf["size"].to_numpy(), target, bool(pdf["_full"].iloc[0]))
        return pd.DataFrame(
            {
                **{c: [pdf[c].iloc[0]] for c in CELL},
                "known": [known],
                "closed": [closed],
                "exit_acc": [acc],
                "exit_parts": [parts],
                "total": [int(pdf["size"].sum())],
                "files": [len(pdf)],
            }
        )

    exits = (
        ordered.select(*CELL, "location", "size")
        .join(spanning.select(*CELL, "_full").toDF(*CELL, "_full"), CELL)
        .groupBy(*CELL)
        .applyInPandas(
            summarise,
            f"{_GROUP_TYPES}, _chunk int, known array<bigint>, closed array<bigint>, "
            "exit_acc array<bigint>, exit_parts array<bigint>, total bigint, files bigint",
        )
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        objects = [o for listed in pdf["_open"] for o in listed]
        growable = [(int(o["size"]), int(o["n_parts"])) for o in objects]
        state, entries = (0, int(pdf["_acc"].iloc[0]), int(pdf["_parts"].iloc[0])), []
        for row in pdf.to_dict("records"):
            entered, acc, parts = state
            state = _leave_chunk(row, state, growable, target)
            # A chunk gets the objects it may add to, and counts new ones from there.
            number = int(row["_next"]) + max(entered - len(growable), 0)
            entries.append((objects[entered : state[0] + 1], number, acc, parts))
        out = pdf[CELL].reset_index(drop=True)
        for i, column in enumerate(_ENTRY):
            out[column] = [e[i] for e in entries]
        return out

    entries = (
        exits.join(spanning.drop("_full"), CELL)
        .groupBy(*GROUP)
        .applyInPandas(walk, f"{_GROUP_TYPES}, _chunk int, _e_open {_OPEN}, _e_next bigint, _e_acc bigint, _e_parts bigint")
    )
    joined = cells.join(entries, CELL, "left")
    return joined.withColumns({c.replace("_e", "", 1): F.coalesce(c, c.replace("_e", "", 1)) for c in _ENTRY})


def _chunk_exits(sizes: np.ndarray, target: int, full: bool):
    """How the walk leaves a chunk of files.

    ``known``: running sizes up to the first file at which any object open at
    the chunk's start must be closed (all of them when ``full``).  For a walk
    that begins an empty object at file ``i``: ``closed[i]`` objects get closed
    by the chunk's end, and the one then open has ``acc[i]`` bytes in
    ``parts[i]`` files.
    """
    n = len(sizes)
    base = np.concatenate(([0], np.cumsum(sizes, dtype="int64")))
    closes_at = np.searchsorted(base[1:], base + target)
    closed, acc, parts = (np.zeros(n + 1, dtype="int64") for _ in range(3))
    for i in range(n - 1, -1, -1):
        if closes_at[i] == n:
            acc[i], parts[i] = base[n] - base[i], n - i
        else:
            after = closes_at[i] + 1
            closed[i], acc[i], parts[i] = closed[after] + 1, acc[after], parts[after]
    last = n if full else min(int(closes_at[0]) + 1, n)
    return base[1 : last + 1], closed[: last + 1], acc[: last + 1], parts[: last + 1]


def _leave_chunk(chunk: dict, state: tuple, growable: list, target: int) -> tuple:
    """State after a chunk, from the state before it and the chunk's exits."""
    k, acc, parts = state
    known, at = np.asarray(chunk["known"]), 0
    while True:
        begun = int(known[at - 1]) if at else 0
        j = int(np.searchsorted(known, begun + target - acc))
        if j == len(known):
            return k, acc + int(chunk["total"]) - begun, parts + int(chunk["files"]) - at
        at, k = j + 1, k + 1
        if k >= len(growable):
            return k + int(chunk["closed"][at]), int(chunk["exit_acc"][at]), int(chunk["exit_parts"][at])
        acc, parts = growable[k]


def _assign_chunk(files: pd.DataFrame, cells: pd.DataFrame, target: int) -> pd.DataFrame:
    """Give every file of one chunk its object and its position in it."""
    files = files.sort_values([*GROUP, "location"], ignore_index=True)
    states = {tuple(c[g] for g in GROUP): c for c in cells.to_dict("records")}
    ordinal = np.zeros(len(files), dtype="int64")
    part_no = np.zeros(len(files), dtype="int64")
    for key, rows in files.groupby(GROUP, sort=False, dropna=False).indices.items():
        cell = states[key]
        growable = [(o["ordinal"], o["size"], o["n_parts"]) for o in cell["_open"]]
        base = np.concatenate(([0], np.cumsum(files["size"].to_numpy()[rows], dtype="int64")))
        k, acc, parts, at = 0, int(cell["_acc"]), int(cell["_parts"]), 0
        while at < len(rows):
            end = min(int(np.searchsorted(base[1:], base[at] + target - acc)) + 1, len(rows))
            number = growable[k][0] if k < len(growable) else int(cell["_next"]) + k - len(growable)
            ordinal[rows[at:end]] = number
            part_no[rows[at:end]] = parts + np.arange(end - at)
            k, at = k + 1, end
            acc, parts = growable[k][1:] if k < len(growable) else (0, 0)
    out = files[[*GROUP, "location", "etag", "size", "last_modified"]].copy()
    out["ordinal"], out["part_no"] = ordinal, part_no
    return out
