"""Spelling variants by sorted rotations of words.

A word with a terminator behind it has as many rotations as characters.  For a
word ``xcy`` with the edited character ``c``, the rotation that starts behind
``c`` is ``y$xc``: the character comes last.  All rotations are sorted.  Those
of one length that agree but for the last character are words that differ by
one replacement; the rotation ``y$x``, which is a whole one of the word ``xy``,
stands right before them and has them as insertions.  So the neighbours of a
word are found in prefix ranges, and never by comparing words.

Rotations are dealt out by a prefix no longer than any that neighbours share and
sorted by Spark within tasks.  A task scans its rotations and keeps the open
prefixes on a stack.  A group holds one word for each character of the alphabet
at most, plus the shorter one, whatever the number of words.

Every pair of neighbours meets once: a replacement has one place, and of a run
of equal characters only the first one counts as inserted.

Null texts have no words, a null id counts as empty.  Texts are read whole; the
occurrences of a text are counted however often a row is repeated.  Other
columns are ignored whatever their names; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.text import column, lower_ascii
from eventweir.session import written_table

#: Stands behind every word; no letter.
END = "$"
#: Letters behind lower-casing A-Z.
RUN = "([a-zÀ-ÿ]+)"


@dataclass(frozen=True)
class Spelling:
    """Shortest words, their least number of occurrences, and how many times as
    frequent as a word its form must be."""

    min_chars: int = 7
    min_count: int = 2
    times: int = 10
    #: One of so many occurrences loses a letter, chosen by a checksum; 0 for none.
    spoil: int = 0

    def __post_init__(self):
        if self.times < 2:
            raise ValueError("a form must be more frequent than its word")


def word_counts(docs: DataFrame, spelling: Spelling = Spelling(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: the words of whole texts and their occurrences."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), F.lit(1))).alias("word"),
    ).where(F.length("word") >= spelling.min_chars)
    if spelling.spoil:
        checksum = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = (checksum % F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(checksum % spelling.spoil == 0, shorter).otherwise(F.col("word")))
        runs = runs.where(F.length("word") >= spelling.min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= spelling.min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``rotation, n`` for every place in the words with their terminators."""
    marked = F.concat("word", F.lit(END))
    places = F.sequence(F.lit(1), F.length("word") + 1)
    rotated = F.transform(places, lambda i: F.concat(F.substring(marked, i, F.length("word") + 1), F.substring(F.col("word"), F.lit(1), i - 1)))
    return words.select(F.explode(rotated).alias("rotation"), "n")


class Group:
    """The words that a prefix range holds: ``whole`` has the prefix as a
    rotation, the others have one more character behind it."""

    __slots__ = ("prefix", "whole", "longer")

    def __init__(self, prefix: str):
        self.prefix, self.whole, self.longer = prefix, None, []

    def neighbours(self) -> Iterator[tuple[str, int, str, int]]:
        """Each word with its number of neighbours in the group and the best one:
        the most frequent, of these the first in code-point order."""
        behind, before = self.prefix.split(END)
        last = before[-1:]  # the character before the edited one
        replaced = sorted((-n, before + c + behind, c != last) for c, n in self.longer)
        inserted = [r for r in replaced if r[2]]
        if self.whole is not None and inserted:
            yield before + behind, len(inserted), inserted[0][1], -inserted[0][0]
        for row in replaced:
            best = replaced[0] if replaced[0] is not row else replaced[1] if len(replaced) > 1 else None
            count = len(replaced) - 1
            if row[2] and self.whole is not None:
                shorter = (-self.whole, before + behind, True)
                best, count = (shorter if best is None else min(best, shorter)), count + 1
            if best is not None:
                yield row[1], count, best[1], -best[0]


def scan(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Neighbours from sorted rotations, group by group."""
    stack: list[Group] = []
    for rotation, n in rows:
        while stack and not rotation.startswith(stack[-1].prefix):
            yield from _closed(stack.pop())
        if rotation[-1] != END:
            prefix = rotation[:-1]
            if not (stack and len(stack[-1].prefix) == len(prefix)):
                stack.append(Group(prefix))
            stack[-1].longer.append((rotation[-1], n))
        stack.append(Group(rotation))
        stack[-1].whole = n
    while stack:
        yield from _closed(stack.pop())


def _closed(group: Group) -> Iterator[tuple[str, int, str, int]]:
    return group.neighbours() if len(group.longer) + (group.whole is not None) > 1 else iter(())


def neighbours(words: DataFrame, min_chars: int = Spelling.min_chars) -> DataFrame:
    """``word, n_near, near, near_n`` of distinct words that have near ones: how
    many, and the most frequent.  No word has fewer than ``min_chars`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int]]:
            for batch in batches:
                yield from zip(column(batch, "rotation").to_pylist(), column(batch, "n").to_pylist(), strict=True)

        found: list[tuple[str, int, str, int]] = []
        for row in scan(rows()):
            found.append(row)
            if len(found) == 20_000:
                yield batch_of(found)
                found.clear()
        yield batch_of(found)

    def batch_of(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        word, count, near, n = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(near, pa.string()), pa.array(n, pa.int64())],
            ["word", "n_near", "near", "near_n"],
        )

    # Prefixes that neighbours share are as long as the shorter word at least.
    dealt = rotations(words).repartition(F.substring("rotation", 1, min_chars)).sortWithinPartitions("rotation")
    found = dealt.mapInArrow(run, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("best")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: the last word that forms lead to.

    Every step doubles the way a word has gone.  Forms are more frequent than
    their words by a factor, so ways are short and have no circle."""
    gone = written_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = gone.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = gone.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written_table(step, "spelling-roots")
        if not step.where("moved").take(1):
            return gone
        gone = step.select("word", "root")


def variants(docs: DataFrame, spelling: Spelling = Spelling(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the texts."""
    words = written_table(word_counts(docs, spelling, text, doc_id), "words")
    near = words.join(neighbours(words, spelling.min_chars), "word", "left")
    is_form = F.col("near_n") >= spelling.times * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    near = written_table(near, "variants")
    found = near.join(roots(near.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
