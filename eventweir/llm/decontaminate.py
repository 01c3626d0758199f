"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item, or all words of a
shorter one.  A document contains a window if all shingles (word pairs) of the
window follow each other in it, so any single shingle is necessary; the prefix
to join on is the rarest one.  Shingles are ordered by how often the documents
hold them, counted over all documents.

1. All documents' shingles meet the benchmark's shingles by hash; what is found
   is stored with its place.  The benchmark's side is broadcast when it is
   measured to be small, else both are shuffled with salted keys.
2. Counts of the stored finds give each window's rarest shingle.
3. Its finds give candidate places; the length bound (the window is not longer
   than the document) and the positional bound (it lies within the document)
   drop some before anything is compared.
4. Each document's candidates are verified by comparing words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null or
empty texts and items have no words; items without words have no windows.
Repeated items count by id.  Documents that repeat a row get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.text import lower_ascii
from eventweir.operators.joins import join_small
from eventweir.session import written_table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; no empty ones, none for null."""
    spaced = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def with_shingles(df: DataFrame, singles: bool) -> DataFrame:
    """Explode ``words`` to ``pos`` and ``shingle``: the hash of a word and the
    next, and with ``singles`` also of each word alone.  The last word has no next."""
    kept = [c for c in df.columns if c != "words"]
    rows = df.select(*kept, "words", F.posexplode("words").alias("pos", "word"))
    pair = F.xxhash64("word", F.get("words", F.col("pos") + 1))
    shingle = F.explode(F.array_distinct(F.array(pair, F.xxhash64("word")))) if singles else pair
    return rows.select(*kept, "pos", shingle.alias("shingle"))


def windows_of(benchmark: DataFrame, size: int, text: str, item_id: str) -> DataFrame:
    """Distinct windows: ``window_id, win`` (words), ``items`` (ids as strings)."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = words.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("start"))
    rows = rows.select("item", F.slice("words", F.col("start"), F.lit(size)).alias("win"))
    distinct = rows.groupBy("win").agg(F.collect_set("item").alias("items"))
    return distinct.withColumn("window_id", F.sha2(F.array_join("win", " "), 256))


def words_hit(found: str) -> Column:
    """Words covered by the verified windows: ascending starts are merged as they come."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def cover(state: Column, w: Column) -> Column:
        end = w["start"] + w["len"]
        new = F.greatest(end - F.greatest(w["start"], state["upto"]), F.lit(0))
        return F.struct((state["n"] + new).alias("n"), F.greatest(end, state["upto"]).alias("upto"))

    return F.coalesce(F.aggregate(F.array_sort(F.col(found)), first, cover)["n"], F.lit(0))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items`` (sorted ids of items with
    occurring windows) and ``contaminated`` (some word is hit)."""
    windows = written_table(windows_of(benchmark, size, item_text, item_id), "windows")
    lengths = windows.select("window_id", F.size("win").alias("len"), F.col("win").alias("words"))
    pairs = with_shingles(lengths, False).withColumnRenamed("pos", "offset")
    # The last word makes no pair, but is all there is in a window of one word.
    pairs = pairs.where((F.col("offset") < F.col("len") - 1) | (F.col("len") == 1))
    singles = bool(lengths.where("len = 1").take(1))
    wanted = written_table(pairs.select("shingle").distinct(), "shingles")

    # 1. Where the documents hold shingles of the benchmark.
    row, who = F.struct(*docs.columns).alias("row"), (F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    words = docs.select(*who, words_of(F.col(text)).alias("words"))
    places = with_shingles(words.withColumn("n_words", F.size("words")), singles)
    finds = written_table(join_small(places, wanted, ["shingle"], ["id", "pos"]), "finds")

    # 2. The rarest shingle of each window.
    counts = finds.groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = pairs.join(counts, "shingle")
    complete = rarest.groupBy("window_id", "len").agg(
        F.min(F.struct("n", "offset", "shingle")).alias("rarest"), F.count("*").alias("known")
    )
    # A window with a shingle that no document holds occurs nowhere.
    complete = complete.where(F.col("known") >= F.greatest(F.col("len") - 1, F.lit(1)))
    prefix = complete.select("window_id", "len", "rarest.offset", "rarest.shingle")
    prefix = written_table(prefix.join(windows, "window_id"), "prefixes")

    # 3. Candidate places.
    candidates = join_small(finds, prefix, ["shingle"], ["id", "pos"]).withColumn("start", F.col("pos") - F.col("offset"))
    candidates = candidates.where((F.col("len") <= F.col("n_words")) & (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    window = F.struct("start", "len", "win", "items")
    candidates = candidates.groupBy("id", "hash").agg(F.collect_set(window).alias("candidates"))
    candidates = candidates.select(F.col("id").alias("its_id"), F.col("hash").alias("its_hash"), "candidates")

    # 4. Verified against the words of the document.
    both = docs.select(row, *who).join(
        candidates, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash")), "left"
    )
    both = both.withColumn("words", words_of(F.col("row")[text]))
    same = lambda w: F.slice(F.col("words"), w["start"] + 1, w["len"]) == w["win"]
    both = both.select("row", F.size("words").alias("n_words"), F.filter("candidates", same).alias("found"))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda w: w["items"]))))
    items = F.coalesce(items, F.array().cast("array<string>"))
    both = both.select("row", F.col("n_words").cast("long"), words_hit("found").cast("long").alias("n_hit"), items.alias("items"))
    made = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    old = [F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return both.select(*old, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
