import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from eventweir.llm import toxicity as t

BAD = ["loathsome", "vermin", "filthster"]


def corpus(n=400, seed=4):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "san", "vor", "el", "dim", "pa"]
    rows = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.3)
        for _ in range(2 * toxic):
            words[r.randrange(len(words))] = r.choice(BAD)
        rows.append((i, " ".join(words), toxic))
    return rows


def scored(table, rows, texts):
    docs = table([r[:2] for r in rows], "doc_id bigint, text string")
    model = t.train(docs, table([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    new = table(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["score"] for r in t.score(new, model).collect()}


def test_held_out_rows_and_misspellings(table):
    rows = corpus()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    texts = [r[1] for r in held] + ["kalo verrmin tu", "kalo loathsomme tu", "kalo mitu re", "", None, "x", "mi " * 30_000]
    scores = scored(table, rows, texts)
    right = [(scores[i] >= t.THRESHOLD) == bool(r[2]) for i, r in enumerate(held)]
    assert np.mean(right) > 0.95
    n = len(held)
    assert scores[n] > scores[n + 2] and scores[n + 1] > scores[n + 2]
    assert all(0 <= s <= 1 for s in scores.values()) and scores[n + 3] == scores[n + 4] < t.THRESHOLD


def test_held_out_labels_do_not_matter(table):
    rows = corpus(120)
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    flipped = [(*r[:2], 1 - r[2]) if held(r) else r for r in rows]
    texts = [r[1] for r in rows[:20]]
    assert scored(table, rows, texts) == scored(table, flipped, texts)


def test_labels_that_teach_nothing(table):
    docs = table([(1, "a"), (2, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 1)], [(None, 1), (1, None)], [(1, 0), (9, 1)]):
        model = t.train(docs, table(labels, "doc_id bigint, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in t.score(docs, model).collect())


def test_windows_cover_each_text():
    counts = np.array([0, 1, t.WINDOW, t.WINDOW + 1, 50])
    starts, ends, first = t.windows(counts)
    begin = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        own = slice(first[i], first[i + 1] if i + 1 < len(first) else None)
        assert set().union(*(range(a, b) for a, b in zip(starts[own], ends[own], strict=True))) == set(range(begin[i], begin[i] + n))


def test_columns_stay(awkward, table):
    docs = awkward(["a", None])
    got = t.score(docs, t.fit([], []))
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"] and got.count() == 4
    assert t.score(table([], "text string"), t.fit([], [])).collect() == []


def test_the_column_equals_the_table(awkward):
    model = t.fit([text for _, text, _ in corpus(200)], [x for _, _, x in corpus(200)])
    df = awkward([corpus(3)[0][1], None, "", "x " * 4000, corpus(200)[7][1]])
    both = t.score(df, model, out="likely").withColumn("same", t.likelihood(F.col("text"), model, max_bytes=20))
    assert both.where("abs(likely - same) < 1e-9").count() == df.count()  # sums run over other chunks


def test_the_fit_runs_in_a_task(table, monkeypatch):
    """The driver's process neither gets the texts nor keeps the memory of a fit."""
    monkeypatch.setattr(t, "fit", lambda texts, labels: t.Model(np.zeros(t.BUCKETS), float(os.getpid()), 0.0, float(len(texts))))
    rows = corpus(40)
    model = t.train(table([r[:2] for r in rows], "doc_id bigint, text string"), table([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    assert model.bias not in (0.0, float(os.getpid()))
