"""Hard negatives by slots of the score axis.

An anchor's positives are its best rows of the same label.  Every positive
allows negatives in a window of scores, and the windows of one anchor overlap.
The windows' upper limits, in descending order, cut the scores into disjoint
slots.  A row belongs to one slot, so one pass over the rows serves all windows:
each task keeps, for every anchor and slot, the ``k`` first rows it has seen,
the tasks' rows meet by anchor and slot, and a window's answer is the first
``k`` of its own slot and all lower ones, cut at its lower limit.

Anchors are a stated query set.  They are taken in blocks of bounded size, each
a matrix that goes to all tasks, and every block passes over all rows.

Scores are inner products of the components times ``scale``, rounded down, so
they are exact integers and the same in any order of summation.

Rows take no part without a label, without an id, without a vector, or with a
null or non-finite component.  Vectors of unequal length count as padded with
zeros; empty ones score 0.  Repeated rows take part each on its own; a row is
never compared with rows of its own id, and anchors that share an id are told
apart by ``anchor_row``.  Ties go to the smaller id.  Other columns are ignored
whatever their names; empty tables give empty results.  Components so large that
a score could leave 56 bits raise an error instead of a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweir.llm.text import column
from eventweir.session import scratch_path, written_table

#: Scores stay below this, so that a hundredfold of them fits 64 bits.
SCORE_LIMIT = 2**56


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of a positive, and the window of the
    negatives' scores in per cent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    #: Anchors compared in one pass over the rows, on average; ``most`` bounds them.
    block: int = 4096

    @property
    def most(self) -> int:
        return 2 * self.block + 64


def vectors(batch: pa.RecordBatch, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The scaled vectors of a batch, padded to ``width``, and which rows take part."""
    lists = column(batch, "vector")
    length = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(length)), length)
    good = ~pa.compute.is_null(lists).to_numpy(zero_copy_only=False)
    for name in ("id", "label"):
        good &= ~pa.compute.is_null(column(batch, name)).to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(length), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    use = good[row]
    with np.errstate(over="ignore", invalid="ignore"):
        out[row[use], place[use]] = np.floor(scale * flat[use])
    return out[good], good


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole numbers."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    if not bound < SCORE_LIMIT:
        raise ValueError("components are too large for exact scores")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Slots:
    """The first ``k`` rows of every anchor and slot among those seen so far."""

    def __init__(self, anchors: int, slots: int, k: int, max_waiting: int = 1_000_000):
        self.k, self.slots, self.max_waiting = k, slots, max_waiting
        self.least = np.full(anchors * slots, np.iinfo(np.int64).min)
        self.kept = [np.zeros((3, 0), np.int64)]
        self.waiting = 0

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        """Rows that can be among the first ones."""
        cell = anchor * self.slots + slot
        can = score >= self.least[cell]
        if can.any():
            self.kept.append(np.stack([cell[can], score[can], row_id[can]]))
            self.waiting += int(can.sum())
            if self.waiting > self.max_waiting:
                self.compact()

    def compact(self) -> np.ndarray:
        """``cell, score, id`` of the first ``k`` of each cell; the rest is forgotten."""
        every = np.concatenate(self.kept, axis=1)
        every = every[:, np.lexsort((every[2], -every[1], every[0]))]
        first = np.concatenate([[True], every[0, 1:] != every[0, :-1]])[: every.shape[1]]
        start = np.maximum.accumulate(np.where(first, np.arange(every.shape[1]), 0))
        rank = np.arange(every.shape[1]) - start
        every = every[:, rank < self.k]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[every[0, full]] = every[1, full]
        self.kept, self.waiting = [every], 0
        return every


@dataclass
class Block:
    """Some anchors as a matrix; ``upper`` (descending) and ``lower`` bound their
    slots once the positives are known."""

    rows: np.ndarray  # anchor_row
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    upper: np.ndarray | None = None
    lower: np.ndarray | None = None


def first_rows(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """``anchor_row, slot, score, id``: the first ``k`` rows of every anchor and slot.

    Without limits there is one slot, of the other rows of the anchor's label;
    else rows of other labels fall into the slot that their score lies in."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # Mining.most anchors at most
    width = block.matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        slots = 1 if b.upper is None else b.upper.shape[1]
        found = Slots(len(b.rows), slots, k)
        for batch in batches:
            matrix, good = vectors(batch, width, scale)
            if not len(matrix):
                continue
            ids = column(batch, "id").to_numpy(zero_copy_only=False)[good].astype(np.int64)
            labels = column(batch, "label").to_numpy(zero_copy_only=False)[good].astype(np.int64)
            step = max(1, 4_000_000 // len(ids))
            for at in range(0, len(b.rows), step):
                some = slice(at, at + step)
                score = products(b.matrix[some], matrix)
                same = b.labels[some, None] == labels[None, :]
                other = b.ids[some, None] != ids[None, :]
                if b.upper is None:
                    slot, fits = np.zeros(score.shape, np.int64), same & other
                else:
                    slot = sum((score <= b.upper[some, j, None]).astype(np.int64) for j in range(slots)) - 1
                    fits = ~same & other & (slot >= 0) & (score >= b.lower[some, None])
                a, r = np.nonzero(fits)
                found.add(a + at, slot[a, r], score[a, r], ids[r])
        cell, score, row_id = found.compact()
        for i in range(0, len(cell), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.rows[cell[part] // slots]), pa.array((cell[part] % slots).astype(np.int32)), pa.array(score[part]), pa.array(row_id[part])],
                ["anchor_row", "slot", "score", "id"],
            )

    some = rows.mapInArrow(run, "anchor_row bigint, slot int, score bigint, id bigint")
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(anchors: DataFrame, mining: Mining) -> Iterator[list]:
    """The stored anchors in parts of bounded size, dealt by a hash of their row numbers."""
    parts = -(-anchors.count() // mining.block)
    for part in range(parts):
        # Twice the mean is some 60 standard deviations off, so the bound never cuts; it only proves the size.
        rows = anchors.where(F.pmod(F.xxhash64("anchor_row"), F.lit(parts)) == part).limit(mining.most + 1).collect()
        if len(rows) > mining.most:
            raise ValueError("more anchors in a block than it may hold")
        yield rows


def mine(rows: DataFrame, is_anchor: Column, mining: Mining = Mining(), row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_row, anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for every anchor and positive that has negatives in its window.

    ``is_anchor`` is a condition on the columns of ``rows``."""
    spark = rows.sparkSession
    named = [F.col(row_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector")]
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    anchors = rows.where(is_anchor).select(*named).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    anchors = written_table(anchors.withColumn("anchor_row", F.monotonically_increasing_id()), "anchors")
    rows = rows.select(*named)
    width = int(rows.agg(F.max(F.size("vector"))).first()[0] or 0) if anchors.take(1) else 0
    paths = []
    for some in blocks(anchors, mining):
        matrix = np.zeros((len(some), max(width, 1)))
        for i, r in enumerate(some):
            matrix[i, : len(r["vector"])] = np.floor(mining.scale * np.array(r["vector"], np.float64))
        block = Block(*(np.array([r[c] for r in some], np.int64) for c in ("anchor_row", "id", "label")), matrix)
        path = scratch_path(spark, "hard-negatives")
        in_block(rows, block, mining).write.parquet(path)
        paths.append(path)
    schema = "anchor_row bigint, anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def in_block(rows: DataFrame, block: Block, mining: Mining) -> DataFrame:
    """The result for the anchors of a block, in two passes over the rows."""
    best = first_rows(rows, block, mining.positives, mining.scale).collect()  # ``positives`` rows an anchor
    at = {int(a): i for i, a in enumerate(block.rows)}
    # Slots without a positive hold no score.
    block.upper = np.full((len(block.rows), mining.positives), np.iinfo(np.int64).min)
    block.lower = np.full(len(block.rows), np.iinfo(np.int64).max)
    for r in best:
        i, score = at[r["anchor_row"]], r["score"]
        block.upper[i, r["rank"] - 1] = mining.high * score // 100
        block.lower[i] = min(block.lower[i], -(-mining.low * score // 100))
    block.upper = -np.sort(-block.upper, axis=1)
    positives = []
    for r in best:
        i = at[r["anchor_row"]]
        # Windows of the same upper limit begin with the slot below it, the last of theirs.
        own_slot = int((block.upper[i] >= mining.high * r["score"] // 100).sum()) - 1
        positives.append((r["anchor_row"], int(block.ids[i]), r["id"], r["score"], r["rank"], own_slot))
    schema = "anchor_row bigint, anchor_id bigint, positive_id bigint, positive_score bigint, p int, own_slot int"
    positives = F.broadcast(rows.sparkSession.createDataFrame(positives, schema))

    kept = first_rows(rows, block, mining.negatives, mining.scale)
    kept = kept.select("anchor_row", "slot", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    suffix = kept.join(positives, "anchor_row").where(F.col("slot") >= F.col("own_slot"))
    order = Window.partitionBy("anchor_row", "p").orderBy(F.desc("negative_score"), "negative_id")
    merged = suffix.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    merged = merged.where(F.col("negative_score") * 100 >= F.col("positive_score") * mining.low)
    return merged.select("anchor_row", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
