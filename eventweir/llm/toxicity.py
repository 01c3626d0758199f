"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams and itself, hashed to ``BUCKETS``
rows of an embedding table.  The embeddings of a window of words are averaged
and go through a linear softmax; table and softmax are trained jointly in
numpy.  Misspelt words share most n-grams with the words they come from.

Texts are scored whole, in overlapping windows: a text is as toxic as its most
toxic window, so a long text does not dilute an insult.  Only texts are
labelled, so a toxic text teaches through the windows that the model so far
holds most toxic, a clean one through all.  A held-back part of the training
rows turns the highest window into a probability.

The softmax being linear, a window's score is the mean of its words' scores, so
tasks need one number per bucket.

The fit takes at most ``max_rows`` labelled rows (``SAMPLE``) of each class, those
of lowest id hash with at most ``max_chars`` characters; everything else runs
over all rows.  A task fits, and only the model goes to the driver.  Without rows of both classes all texts get the share of toxic
rows.  Empty and null texts are scored as a window of neutral words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.bpe import gather
from eventweir.llm.text import column, fields, text_chunks

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 3, 1
THRESHOLD = 0.3
SAMPLE = {"max_rows": 2000, "max_chars": 20_000}
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, one word after the other, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(codes), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[: max(len(codes) - n + 1, 0)] = codes[n - 1 :]
            rolling = (rolling ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(29)
            if n in GRAMS:
                valid = left >= n
                buckets.append(_bucket(rolling[valid], n))
                owners.append(owner[valid])
        # The whole word: a sum of its characters, each mixed with its place.
        place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        mixed = (codes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB))
        mixed ^= mixed >> np.uint64(31)
        whole = np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), ends - lengths) if len(words) else mixed
    buckets.append(_bucket(whole, 99))
    owners.append(np.arange(len(words)))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    owners = owners[order]
    return buckets[order], np.searchsorted(owners, np.arange(len(words)))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (hashes + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows over texts of so many words that lie one
    after the other, and the first window of each text.  An empty text has one empty window."""
    begin = np.cumsum(counts) - counts
    last = np.maximum(counts - WINDOW, 0)
    n = -(-last // STRIDE) + 1
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    starts = np.repeat(begin, n) + np.minimum(step * STRIDE, np.repeat(last, n))
    return starts, np.minimum(starts + WINDOW, np.repeat(begin + counts, n)), first


@dataclass(frozen=True)
class Model:
    """Score per bucket, the softmax's bias, and the scale of the probability."""

    buckets: np.ndarray
    bias: float
    slope: float
    offset: float

    def word_scores(self, words: list[str], at_once: int = 20_000) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(words), at_once):
            grams, first = subwords(words[i : i + at_once])
            sizes = np.diff(np.concatenate([first, [len(grams)]]))
            out.append(np.add.reduceat(self.buckets[grams], first) / sizes)
        return np.concatenate(out)

    def probabilities(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (highest + self.bias) + self.offset, -500, 500)))


def highest_windows(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest mean word score of any window of each text."""
    if not len(counts):
        return np.zeros(0)
    starts, ends, first = windows(counts)
    upto = np.concatenate([[0], np.cumsum(scores)])
    return np.maximum.reduceat((upto[ends] - upto[starts]) / np.maximum(ends - starts, 1), first)


class Training:
    """Windows of words, and the parameters fitted to them by Adam."""

    def __init__(self, texts: list[str], seed: int):
        index: dict[str, int] = {}
        docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
        self.vocabulary = list(index)
        del index
        self.flat = np.concatenate([np.zeros(0, np.int32), *docs])
        self.counts = np.array([len(d) for d in docs], np.int64)
        self.starts, self.ends, self.first = (a.astype(np.int32) for a in windows(self.counts))
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(np.concatenate([self.first, [len(self.starts)]])))
        parts = [subwords(self.vocabulary[i : i + 20_000]) for i in range(0, len(self.vocabulary), 20_000)]
        self.grams = np.concatenate([np.zeros(0, np.int32), *(grams.astype(np.int32) for grams, _ in parts)])
        sizes = np.cumsum([0, *(len(grams) for grams, _ in parts)])
        self.gram_first = np.concatenate([np.zeros(0, np.int64), *(first + n for (_, first), n in zip(parts, sizes, strict=False))])
        self.gram_n = np.diff(np.concatenate([self.gram_first, [len(self.grams)]]))
        self.rng = np.random.default_rng(seed)
        self.table = self.rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
        self.softmax, self.bias = self.rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.table, self.softmax, self.bias)]
        self.steps = 0

    def model(self) -> Model:
        direction = self.softmax[:, 1] - self.softmax[:, 0]
        return Model(self.table @ direction, float(self.bias[1] - self.bias[0]), 1.0, 0.0)

    def scores(self) -> np.ndarray:
        """Logit of every window."""
        model = self.model()
        of_words = np.add.reduceat(model.buckets[self.grams], self.gram_first) / self.gram_n
        upto = np.concatenate([[0], np.cumsum(of_words[self.flat])])
        return (upto[self.ends] - upto[self.starts]) / np.maximum(self.ends - self.starts, 1) + model.bias

    def step(self, chosen: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One update from some windows, none empty, and their labels."""
        length = self.ends[chosen] - self.starts[chosen]
        words, _ = gather(self.flat, self.starts[chosen], length.astype(np.int64))
        window = np.repeat(np.arange(len(chosen)), length)
        words, place = np.unique(words, return_inverse=True)
        gram_n = self.gram_n[words]
        grams, _ = gather(self.grams, self.gram_first[words], gram_n)
        of_words = np.add.reduceat(self.table[grams], np.cumsum(gram_n) - gram_n, axis=0) / gram_n[:, None]
        x = np.add.reduceat(of_words[place], np.cumsum(length) - length, axis=0) / length[:, None]
        logits = x @ self.softmax + self.bias
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -500, 500)))
        error = (p - y) / len(y)
        d_logits = np.stack([-error, error], axis=1)
        d_x = (d_logits @ self.softmax.T) / length[:, None]
        d_table = np.empty_like(self.table)
        for k in range(WIDTH):
            d_word = np.bincount(place, d_x[window, k], len(words)) / gram_n
            d_table[:, k] = np.bincount(grams, np.repeat(d_word, gram_n), BUCKETS)
        self.steps += 1
        gradients = (d_table, x.T @ d_logits, d_logits.sum(axis=0))
        for parameter, gradient, (mean, square) in zip((self.table, self.softmax, self.bias), gradients, self.moments, strict=True):
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            unbiased = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            parameter -= rate * unbiased * mean / (np.sqrt(square) + 1e-8)


def fit(texts: list[str], labels: list[int], epochs: int = 12, steps: int = 20, batch: int = 2048, rate: float = 0.02, seed: int = 7) -> Model:
    """Train on some texts; every fifth is kept back for the scale.

    An update takes as many windows of toxic texts as of clean ones."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    t = Training(texts, seed)
    teach = ~held[t.doc] & (t.ends > t.starts)
    clean, toxic = np.flatnonzero(teach & (y[t.doc] == 0)), np.flatnonzero(teach & (y[t.doc] == 1))
    if not (len(clean) and len(toxic) and 0 < y[held].sum() < held.sum()):
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    for epoch in range(epochs):
        chosen, hard = toxic, clean
        if epoch >= 2:
            # Windows of toxic texts that the model holds toxic, one of each text at least,
            # and half of the clean ones from those it is least sure of.
            scores = t.scores()
            top = np.maximum.reduceat(np.where(teach, scores, -np.inf), t.first)[t.doc]
            chosen = toxic[scores[toxic] >= np.minimum(top[toxic], 0.0)]
            hard = clean[scores[clean] >= np.quantile(scores[clean], 0.98)]
        for _ in range(steps):
            parts = ((chosen, batch // 2), (clean, batch // 4), (hard, batch // 4))
            some = np.concatenate([t.rng.choice(windows_of, n) for windows_of, n in parts])
            t.step(some, y[t.doc[some]], rate)
    best = np.maximum.reduceat(t.scores(), t.first)
    model = t.model()
    return Model(model.buckets, model.bias, *scale_to_labels(best[held], y[held]))


def scale_to_labels(best: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back texts, by Newton steps."""
    middle, spread = float(np.median(best)), float(best.std()) or 1.0
    x = np.stack([(best - middle) / spread, np.ones(len(best))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    slope = max(w[0], 0.0) / spread
    return float(slope), float(w[1] - slope * middle)


def is_held_out(doc_id: Column) -> Column:
    """Rows that must not teach: crc32 of the id as text has the remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE["max_rows"], max_chars: int = SAMPLE["max_chars"]) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; the
    class shares of all of them set the prior.

    ``labels`` has ``doc_id, toxic``; a document labelled twice is toxic if one label says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sides = []
    for toxic in (0, 1):
        side = known.where(F.col("toxic") == toxic).select("doc_id", "toxic")
        sides.append(side.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = sides[0].union(sides[1])  # at most twice max_rows ids
    texts = docs.select(F.col("doc_id"), F.col("text")).where(F.length("text") <= max_chars)
    model, n_rows, taught = fit_in_task(texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_rows or not n_toxic or n_toxic == n or not 0 < taught < n_rows:
        return model
    # The sample has other class shares than all labelled rows.
    shift = np.log(n_toxic / (n - n_toxic)) - np.log(taught / (n_rows - taught))
    return Model(model.buckets, model.bias, model.slope, model.offset + float(shift))


def fit_in_task(sample: DataFrame) -> tuple[Model, int, int]:
    """The model of a bounded sample of ``doc_id, text, toxic``, its rows and the toxic ones of them.

    The texts go to one task, so the driver gets a number for each of ``BUCKETS`` only."""
    names = ["buckets", "bias", "slope", "offset", "n_rows", "taught"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, toxic = [], [], []
        for batch in batches:
            for values, name in ((ids, "doc_id"), (texts, "text"), (toxic, "toxic")):
                values.extend(column(batch, name).to_pylist())
        order = sorted(range(len(ids)), key=ids.__getitem__)
        y = [int(toxic[i]) for i in order]
        model = fit([texts[i] for i in order], y)
        row = [model.buckets.astype("<f8").tobytes(), model.bias, model.slope, model.offset, len(y), sum(y)]
        yield pa.RecordBatch.from_arrays([pa.array([value]) for value in row], names)

    schema = "buckets binary, bias double, slope double, offset double, n_rows bigint, taught bigint"
    found = sample.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, schema).first()
    if found is None:  # no task runs over a sample that Spark knows to be empty
        return fit([], []), 0, 0
    return Model(np.frombuffer(found["buckets"], "<f8"), *found[1:4]), found["n_rows"], found["taught"]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Replace nothing and add ``out``: the probability that a text is toxic."""
    others = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for chunk in text_chunks(batch, text):
                likely = probabilities(model, column(chunk, text).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*[column(chunk, c) for c in others], pa.array(likely)], [*others, out])

    return docs.mapInArrow(run, ", ".join(filter(None, [fields(docs, *others), f"`{out}` double"])))


def probabilities(model: Model, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
    """The probability for each text; ``known`` keeps the scores of words, 100,000 and those of one call at most."""
    found = [words_of(t) for t in texts]
    if len(known) > 100_000:
        known.clear()
    new = list(set().union(*found) - known.keys())
    known.update(zip(new, model.word_scores(new).tolist(), strict=True))
    scores = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.float64)
    return model.probabilities(highest_windows(scores, np.array([len(f) for f in found], np.int64)))


def likelihood(text: Column, model: Model, max_bytes: int = 1_000_000) -> Column:
    """The probability that a text is toxic, as a column.

    Only the texts go to Python and only numbers come back; what else the rows
    hold stays in the JVM."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            chunks = [probabilities(model, column(c, "text").to_pylist(), known) for c in text_chunks(batch, "text", max_bytes)]
            yield pa.array(np.concatenate([np.zeros(0), *chunks]))
        known.clear()
        pa.default_memory_pool().release_unused()

    return run(text)
