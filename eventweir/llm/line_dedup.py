"""Line deduplication over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the hash of a line's key, with the
number of documents that hold the key.  Runs of one level are merged into one
of the next level when there are ``fanout`` of them, so a batch is rewritten a
logarithmic number of times.  Each new batch is anti-joined with the hashes
that are settled already (found in ``min_docs`` documents or more), and what
remains becomes its own run; runs and batch share their buckets, so the merge
moves the batch only.

A key is a line without the blanks at its ends and with A-Z in lower case,
known by two 64-bit hashes.  A null or empty text is one empty line.  Every row
is a document, so repeated rows count each.  Keys shorter than ``min_chars``
are never dropped.  Extra columns of any name stay as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.llm.text import BLANKS, lower_ascii
from eventweir.session import remove_tables, scratch_path

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_hashes(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit(1), key)}).drop(key)


@dataclass
class LineRuns:
    """The runs of a corpus, below one folder of the shared storage."""

    spark: SparkSession
    root: str
    min_docs: int
    buckets: int
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        # A union of bucketed tables claims their partitioning in this Spark
        # but does not keep it, and sums over it come out wrong.
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def add(self, counts: DataFrame) -> None:
        """Add a batch: ``h1, h2, n_docs`` with one row per key."""
        batch = counts.repartition(self.buckets, *KEY)
        for name in self._names():
            settled = self._read(name).where(F.col("n_docs") >= self.min_docs).select(*KEY)
            batch = batch.join(settled.hint("merge"), KEY, "left_anti")
        self._put(0, self._write(batch))

    def frequent(self) -> DataFrame:
        """Hashes found in at least ``min_docs`` documents of all batches."""
        while len(self._names()) > 1:
            self._merge_level(next(i for i, runs in enumerate(self.levels) if runs), everything=True)
        runs = [self._read(n) for n in self._names()]
        return reduce(DataFrame.union, runs).where(F.col("n_docs") >= self.min_docs).select(*KEY)

    def drop(self) -> None:
        """Take the runs out of the catalog and delete them."""
        for name in self._names():
            self._remove(name)
        self.levels = []

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_tables(self.spark, f"{self.root}/{name}")

    def _names(self) -> list[str]:
        return [name for runs in self.levels for name in runs]

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._merge_level(level)

    def _merge_level(self, level: int, everything: bool = False) -> None:
        names = self._names() if everything else self.levels[level]
        merged = reduce(DataFrame.union, [self._read(n) for n in names])
        merged = merged.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"))
        name = self._write(merged.repartition(self.buckets, *KEY))
        if everything:
            self.levels = [[] for _ in self.levels]
        else:
            self.levels[level] = []
        for old in names:
            self._remove(old)
        self._put(level + 1, name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}")
        writer.format("parquet").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, text: str = "text") -> DataFrame:
    """Hashes of the line keys found in at least ``min_docs`` documents, as a stored table.

    The documents are taken in ``batches`` batches; their line hashes are
    written once, parted by batch.  Counts are summed in the tasks before the
    shuffle, so a line that most documents hold does not meet in one task.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "line-runs")
    keys = F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= min_chars)
    batch = F.pmod(F.monotonically_increasing_id(), F.lit(batches)).alias("batch")
    rows = docs.select(batch, F.explode(F.array_distinct(keys)).alias("key"))
    with_hashes(rows, "key").write.partitionBy("batch").parquet(f"{root}/hashes")
    hashes = spark.read.schema("h1 bigint, h2 bigint, batch bigint").parquet(f"{root}/hashes")

    runs = LineRuns(spark, root, min_docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(batches):
        runs.add(hashes.where(F.col("batch") == i).groupBy(*KEY).agg(F.count("*").alias("n_docs")))
    runs.frequent().write.parquet(f"{root}/frequent")
    runs.drop()
    return spark.read.schema("h1 bigint, h2 bigint").parquet(f"{root}/frequent")


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines whose key is in ``frequent``, and the columns
    ``n_lines`` (before) and ``n_dropped``.  A text that loses nothing stays as
    it is; one that loses all lines becomes empty.

    Only hashes of lines meet ``frequent``; what comes back to the documents is
    the numbers of the lines to leave out.
    """
    row, lines = F.struct(*docs.columns).alias("row"), lines_of(F.col(text))
    who = (F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    numbered = docs.select(*who, F.posexplode(lines).alias("line_no", "line"))
    numbered = numbered.withColumn("key", line_key(F.col("line"))).drop("line").where(F.length("key") >= min_chars)
    found = with_hashes(numbered, "key").join(frequent, KEY, "inner")
    drops = found.groupBy("id", "hash").agg(F.collect_set("line_no").alias("dropped"))
    drops = drops.select(F.col("id").alias("its_id"), F.col("hash").alias("its_hash"), "dropped")

    both = docs.select(row, *who, lines.alias("lines"))
    both = both.join(drops, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    new = {
        text: F.when(F.col("dropped").isNull(), F.col("row")[text]).otherwise(kept),
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
    }
    old = [F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    result = both.select(*old, *[value.alias(name) for name, value in new.items()])
    return result.select(*dict.fromkeys([*docs.columns, *new]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that stand in at least ``min_docs`` documents; see ``drop_lines``."""
    return drop_lines(docs, frequent_lines(docs, min_docs, min_chars, batches, text), min_chars, text, doc_id)
