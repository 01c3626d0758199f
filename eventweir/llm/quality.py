"""Text quality by weak supervision.

Rules look at statistics of a whole text and vote: good, bad, or not at all.
No rule decides alone.  A text has a hidden class, and each rule a chance to
vote rightly on each class; expectation-maximisation finds both from how the
votes of all documents agree, without labels.  A text's quality is the
probability of the good class given its votes.

What the fit needs of the corpus is how often each combination of votes occurs.
Spark counts them; with three outcomes for each rule there are ``3 ** len(RULES)``
combinations at most, whatever the number of documents, and only these counts
go to the driver.  Silent rules say nothing about the class.

Nulls and empty texts have no words and fail.  Texts are read whole, very long
ones in pieces.  Repeated rows count each on their own; rows without an id are
judged as others.  The text column is not returned, and a column named like one
of the results is replaced by it.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.text import column, fields, text_chunks
from eventweir.session import written_table

#: Statistics of a text, all integers.
STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_top", "n_letters", "n_capitals", "n_shouts"
]
SYMBOLS = b"#*$%&|<>"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
CONTINUATION = bytes(range(0x80, 0xC0))


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts that end at blanks, so that its words need not all be held."""
    start = 0
    while start < len(raw):
        cut = BLANK.search(raw, min(start + size, len(raw)))
        end = cut.end() if cut else len(raw)
        yield raw[start:end]
        start = end


def repeated(words: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, the words in windows of three that its text holds twice or more."""
    if len(words) < 3:
        return np.zeros(n_texts, np.int64)
    n = int(words.max()) + 1
    _, pair = np.unique(words[:-1] * n + words[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * n + words[2:], return_inverse=True)
    inside = np.flatnonzero(text[:-2] == text[2:])
    _, place, times = np.unique(triple[inside] * n_texts + text[inside], return_inverse=True, return_counts=True)
    twice = inside[times[place] > 1]
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[twice + i] = True
    return np.bincount(text[marked], minlength=n_texts)


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The statistics of some texts."""
    out = {name: np.zeros(len(texts), np.int64) for name in STATISTICS}
    index: dict[bytes, int] = defaultdict(count().__next__)
    found = []
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for piece in pieces(raw):
            words = piece.split()
            found.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            out["n_words"][i] += len(words)
        lines = [line for line in raw.split(b"\n") if line.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_symbols"][i] = sum(raw.count(symbol) for symbol in SYMBOLS)
        out["n_shouts"][i] = raw.count(b"!") + raw.count(b"?")
        out["word_chars"][i] = len(raw.translate(None, CONTINUATION + b" \t\n\x0b\x0c\r"))
        out["n_letters"][i] = len(raw.translate(None, CONTINUATION + NOT_LETTERS))
        plain = raw.translate(None, NOT_ASCII_LETTERS)
        # A share of capitals among ASCII letters, as a count among all letters.
        out["n_capitals"][i] = len(plain.translate(None, NOT_CAPITALS)) * out["n_letters"][i] // max(len(plain), 1)
    words = np.concatenate(found) if found else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), out["n_words"])
    out["n_repeat_words"] = repeated(words, text, len(texts))
    if len(words):
        of_text, times = np.unique(text * len(index) + words, return_counts=True)
        of_text //= len(index)
        out["n_distinct"] = np.bincount(of_text, minlength=len(texts))
        first = np.flatnonzero(np.concatenate([[True], of_text[1:] != of_text[:-1]]))
        out["n_top"][of_text[first]] = np.maximum.reduceat(times, first)
    return out


@dataclass(frozen=True)
class Rule:
    """Votes by ``part`` per ``whole``: good in ``good``, bad outside ``fair``,
    else silent; silent too where ``whole`` is below ``least``."""

    name: str
    part: str
    whole: str | None
    good: tuple[float, float]
    fair: tuple[float, float]
    least: int = 1


#: The rules and their limits.
RULES = [
    Rule("length", "n_words", None, (100, np.inf), (50, np.inf)),
    Rule("word_length", "word_chars", "n_words", (3, 10), (2, 14)),
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (0, 0.1), 10),
    Rule("letters", "n_letters", "word_chars", (0.9, 1), (0.8, 1), 20),
    Rule("capitals", "n_capitals", "n_letters", (0, 0.2), (0, 0.4), 20),
    Rule("shouts", "n_shouts", "n_words", (0, 0.05), (0, 0.2), 10),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.1), (0, 0.3), 10),
    Rule("lines", "n_dup_lines", "n_lines", (0, 0.1), (0, 0.3), 4),
    Rule("top_word", "n_top", "n_words", (0, 0.15), (0, 0.25), 20),
    Rule("line_words", "n_words", "n_lines", (5, np.inf), (2, np.inf)),
]
SILENT, GOOD, BAD = 0, 1, 2


def votes(found: dict[str, np.ndarray], rules: list[Rule] = RULES) -> np.ndarray:
    """Outcome of every rule (rows) for every text."""
    out = np.zeros((len(rules), len(found["n_words"])), np.int64)
    for j, rule in enumerate(rules):
        whole = found[rule.whole] if rule.whole else np.ones_like(found[rule.part])
        share = found[rule.part] / np.maximum(whole, 1)
        is_good = (share >= rule.good[0]) & (share <= rule.good[1])
        is_bad = (share < rule.fair[0]) | (share > rule.fair[1])
        out[j] = np.where(whole < rule.least, SILENT, np.where(is_good, GOOD, np.where(is_bad, BAD, SILENT)))
    return out


@dataclass(frozen=True)
class Fit:
    """Start and strength of the prior belief, and the steps of the fit.

    The belief is that rules are rather right than wrong: ``right`` of their
    votes, counted as ``belief`` of all documents' votes."""

    share_good: float = 0.8
    right: tuple[float, float] = (0.95, 0.3)  # on good texts, on bad texts
    belief: float = 0.02
    steps: int = 200


@dataclass(frozen=True)
class Model:
    """``log_odds[rule, outcome]`` and the prior log odds of the good class."""

    accuracies: np.ndarray  # rule, class (good, bad): chance of a right vote
    share_good: float

    def quality(self, outcomes: np.ndarray) -> np.ndarray:
        """Probability of the good class for columns of outcomes."""
        right_good, right_bad = self.accuracies[:, :1], self.accuracies[:, 1:]
        for_good = np.log(right_good) - np.log(1 - right_bad)
        for_bad = np.log(1 - right_good) - np.log(right_bad)
        odds = np.where(outcomes == GOOD, for_good, np.where(outcomes == BAD, for_bad, 0.0)).sum(axis=0)
        odds += np.log(self.share_good) - np.log(1 - self.share_good)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(outcomes: np.ndarray, weight: np.ndarray, how: Fit = Fit()) -> Model:
    """Expectation-maximisation over combinations of votes (columns) and their numbers."""
    n_rules, total = len(outcomes), float(weight.sum())
    believed = max(how.belief * total, 1.0)
    start = np.tile(np.array(how.right), (n_rules, 1))
    model = Model(start, how.share_good)
    is_good, is_bad = outcomes == GOOD, outcomes == BAD
    for _ in range(how.steps):
        good = model.quality(outcomes) * weight
        bad = weight - good
        right_good = (is_good @ good + believed * start[:, 0]) / ((is_good | is_bad) @ good + believed)
        right_bad = (is_bad @ bad + believed * start[:, 1]) / ((is_good | is_bad) @ bad + believed)
        share = (good.sum() + believed * how.share_good) / (total + believed)
        # A rule whose votes hardly differ between the classes says little, but never the opposite.
        right_bad = np.maximum(right_bad, 1 - right_good)
        model = Model(np.stack([right_good, right_bad], axis=1), float(share))
    return model


def described(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The statistics of every text and its votes as one number; the text itself goes."""
    others = [c for c in docs.columns if c not in (text, *STATISTICS, "votes")]
    base = 3 ** np.arange(len(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, text, 2_000_000):
                found = statistics(column(chunk, text).to_pylist())
                number = base @ votes(found, rules)
                yield pa.RecordBatch.from_arrays(
                    [*[column(chunk, c) for c in others], *[pa.array(found[name]) for name in STATISTICS], pa.array(number)],
                    [*others, *STATISTICS, "votes"],
                )

    schema = ", ".join(filter(None, [fields(docs, *others), *[f"{name} bigint" for name in STATISTICS], "votes bigint"]))
    return docs.select(*others, text).mapInArrow(run, schema)


def outcomes_of(numbers: np.ndarray, rules: list[Rule] = RULES) -> np.ndarray:
    """The votes behind some numbers, rules as rows."""
    return numbers[None, :] // 3 ** np.arange(len(rules))[:, None] % 3


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: list[Rule] = RULES,
    threshold: float = 0.5,
    how: Fit = Fit(),
    must: Callable[[], Column] | None = None,
) -> DataFrame:
    """Other columns of ``docs``, the statistics, ``quality`` and ``kept``.

    ``must`` gives a condition on the statistics; texts that do not meet it are
    not kept whatever their quality."""
    spark = docs.sparkSession
    known = written_table(described(docs.drop("quality", "kept"), text, rules), "quality-statistics")
    counts = known.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** len(rules) rows at most
    numbers = np.array([r["votes"] for r in counts], np.int64)
    outcomes = outcomes_of(numbers, rules)
    model = fit(outcomes, np.array([r["n"] for r in counts], np.float64), how)
    rows = [(int(v), float(q)) for v, q in zip(numbers, model.quality(outcomes), strict=True)]
    quality = spark.createDataFrame(rows, "votes bigint, quality double")
    judged = known.join(F.broadcast(quality), "votes", "left").drop("votes")
    kept = F.col("quality") >= threshold
    return judged.withColumn("kept", kept if must is None else kept & must())
