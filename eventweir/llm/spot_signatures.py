"""Spot signatures: chains of content words that follow common words.

Every common word (the anchor) with the next two content words, common words
in between skipped, is a signature; a text's fingerprint is the set of its
signatures, as ascending 32-bit hashes of eight hex digits each.  A text with
words but no complete chain has itself as its only signature; an empty or null
text has none.  Likeness is the Jaccard similarity of the sets, 1 for two empty
ones; equal texts have equal fingerprints.

Documents are paired with the next by id without one task for all: ids are cut
into ranges, and the first document of a range also goes to the range before.
Rows that repeat an id follow each other by text; rows without an id come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweir.llm.text import lower_ascii
from eventweir.session import written_table

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to a in is that it was for on are as with at be this have from or by not but "
    "le la les de des du et un une en est que qui dans pour pas sur au avec il elle ne se "
    "der die das und ist ein eine den dem des mit nicht von zu im auf sich auch als an er sie "
    "el los las y del al por con para una su lo como no se ya que"
)
CHAIN = 2
MAX_RANGES = 100_000


def signatures(text: Column, anchors: str = ANCHORS, chain: int = CHAIN) -> Column:
    """Ascending distinct signature hashes of a text, an array of int."""
    text = F.coalesce(text, F.lit(""))
    spaced = F.btrim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    common = "|".join(sorted(set(anchors.split()), key=lambda w: (-len(w), w)))
    marked = F.regexp_replace(spaced, f"(?<![^ ])(?:{common})(?![^ ])", "\u0001$0")
    content = "(?: \u0001[^ ]++)*+ [^ \u0001][^ ]*+"
    found = F.regexp_extract_all(marked, F.lit(f"(?=\u0001([^ ]++(?:{content}){{{chain}}}))"), 1)
    whole = F.when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    chained = F.transform(found, lambda s: F.hash(F.regexp_replace(s, " \u0001[^ ]+", "")))
    # No chain at all is told by the marked text, so that nothing is searched twice.
    return F.array_sort(F.array_distinct(F.concat(chained, F.when(marked.rlike(f"\u0001[^ ]++(?:{content}){{{chain}}}"), F.array().cast("array<int>")).otherwise(whole))))


def as_text(found: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look at them if their sizes
    already keep it below ``at_least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when(small < large * at_least, F.lit(0.0))
        .otherwise(common / (small + large - common))
    )


def with_next(docs: DataFrame, text: str, doc_id: str, min_width: int = 256) -> tuple[DataFrame, Window]:
    """``id, text, follower`` of all documents, a document's next one being the
    next row of the returned window; after the last comes the first.

    Rows with ``follower`` are there for the row before only."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ids = rows.select("id")
    least, most = ids.agg(F.min("id"), F.max("id")).first()
    least, most = (0, 0) if least is None else (least, most)
    width = max(min_width, -(-(most - least + 1) // MAX_RANGES))
    part = F.coalesce(F.floor((F.col("id") - F.lit(least)) / F.lit(width)).cast("bigint"), F.lit(-1).cast("bigint"))
    # At most MAX_RANGES + 1 rows.
    firsts = ids.groupBy(part.alias("part")).agg(F.min("id").alias("first_id"))
    by_part = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(by_part), F.max("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("part").alias("its_part"), F.col("first_id"), before.alias("before"))
    rows = rows.withColumn("part", part)
    is_first = (F.col("part") == F.col("its_part")) & F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.join(F.broadcast(firsts), is_first, "left")
    targets = F.when(F.col("before").isNull(), F.array("part")).otherwise(F.array("part", "before"))
    rows = rows.select("id", "text", F.posexplode(targets).alias("follower", "target"))
    window = Window.partitionBy("target").orderBy("follower", "id", F.xxhash64("text"), "text")
    return rows, window


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next document."""
    rows, window = with_next(docs, text, doc_id)
    rows = rows.withColumn("next_text", F.lead("text").over(window)).withColumn("found", signatures(F.col("text")))
    rows = rows.withColumn("next_found", F.lead("found").over(window)).where(F.col("follower") == 0)
    rows = rows.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_found", signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias(doc_id), F.col("n_chars").cast("long").alias("n_chars"), "edited", "found", "edited_found",
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def near_links(found: DataFrame, at_least: float = 0.8, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All pairs of different signature sets that are alike, and who has which set.

    Sets are parted by length, so that a set meets its own part and the next
    only.  Within a part two sets meet if they share one of the signatures they
    cannot both be without: the ``n - ceil(at_least * n) + 1`` of lowest hash.
    Each set is compared once for all documents that share it; returns
    ``(a, b, likeness)`` between representatives and ``(doc_id, representative)``.
    """
    rows = found.select(F.col(doc_id).alias("id"), "found").where(F.size("found") > 0)
    sets = rows.groupBy("found").agg(F.min("id").alias("rep"))
    sets = written_table(sets, "signature-sets")
    members = rows.join(sets, "found").select(F.col("id").alias(doc_id), F.col("rep").alias("representative"))
    n = F.size("found")
    part = F.floor(F.log(n) / F.log(F.lit(1 / at_least))).cast("int")
    prefix = F.slice("found", F.lit(1), n - F.ceil(n * at_least).cast("int") + 1)
    entries = sets.select("rep", n.alias("n"), part.alias("part"), F.explode(prefix).alias("signature"))
    below = entries.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "part", "signature")
    above = entries.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "signature")
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * at_least) & (F.col("a") != F.col("b"))
    pairs = below.join(above, ["part", "signature"]).where(fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = lambda name: sets.select(F.col("rep").alias(name), F.col("found").alias(f"found_{name}"))
    pairs = pairs.join(own("a"), "a").join(own("b"), "b")
    pairs = pairs.withColumn("likeness", likeness(F.col("found_a"), F.col("found_b"), at_least))
    return pairs.where(F.col("likeness") >= at_least).select("a", "b", "likeness"), members
