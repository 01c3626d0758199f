import random
import re
from collections import Counter

import numpy as np
import pytest

from eventweir.llm import quality as q
from eventweir.llm import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(marked),
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
        "n_top": max(Counter(words).values(), default=0),
    }


TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "a a a a",
    "a b c a b c",
    "a b c d a b",
    "x y z\nx y z\n x y z\n\n\nx\x0by\x0cz     éé\U0001f600",
    "#### | $ <b> & 50 % * & x # \n#### | $",
    "WORDS! in? Capitals 123 ÄÖÜ",
    "tail of one text",
    "tail of one",
]


def test_statistics_equal_brute_force():
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choice("abcd") for _ in range(r.randrange(60))) for _ in range(60)]
    found = q.statistics(texts)
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert found[name][i] == value, (name, text)


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(q.pieces, "__defaults__", (7,))
    text = "ab cd  ef\nghijklmnopqr st\tu " * 9
    found = q.statistics([text, "ab cd"])
    assert {name: found[name][0] for name in brute(text)} == brute(text)
    assert b"".join(q.pieces(text.encode())) == text.encode()


def test_votes_are_numbers_and_back():
    found = q.statistics(TEXTS)
    outcomes = q.votes(found)
    assert (q.outcomes_of(3 ** np.arange(len(q.RULES)) @ outcomes) == outcomes).all()
    assert (outcomes[:, 0] != q.GOOD).all()


def simulated(n, accuracies, share, seed):
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    right = np.where(good, accuracies[:, :1], accuracies[:, 1:]) > r.random((len(accuracies), n))
    votes = np.where(right == good, q.GOOD, q.BAD)
    votes[r.random(votes.shape) < 0.2] = q.SILENT
    return good, votes


def test_the_fit_finds_accuracies():
    true = np.array([[0.99, 0.6], [0.95, 0.8], [0.9, 0.5], [0.97, 0.3], [0.98, 0.7], [0.9, 0.9]])
    good, votes = simulated(40_000, true, 0.75, 3)
    combinations, weight = np.unique(votes, axis=1, return_counts=True)
    model = q.fit(combinations, weight.astype(float))
    assert np.abs(model.accuracies - true).max() < 0.08 and abs(model.share_good - 0.75) < 0.04
    kept = model.quality(votes) >= 0.5
    every = (votes != q.BAD).all(axis=0)
    assert (kept == good).mean() > max(0.93, (every == good).mean() + 0.1)


def made(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(120)]
        junk = i % 5 == 0
        if junk:
            words = [[w + "$$$" for w in words], [w.upper() + "!!" for w in words], words[:2] * 60][i // 5 % 3]
        rows.append((i, "\n".join(" ".join(words[at : at + 15]) for at in range(0, 120, 15)), junk))
    return rows


def test_junk_goes_and_good_texts_stay(table):
    rows = made(6)
    judged = {r["doc_id"]: r for r in q.judge(table([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    assert [judged[i]["kept"] for i, _, _ in rows] == [not junk for _, _, junk in rows]


def test_query_equals_its_parts(spark, table, folder):
    rows = [r[:2] for r in made(7)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again")]
    path = folder("tables")
    table(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op13_quality"](spark, path).collect()), key=repr)
    found = q.statistics([t for _, t in rows])
    outcomes = q.votes(found)
    combinations, weight = np.unique(outcomes, axis=1, return_counts=True)
    likely = q.fit(combinations, weight.astype(float)).quality(outcomes)
    expected = []
    for (i, t), quality in zip(rows, likely.tolist(), strict=True):
        b = brute(t)
        failed = b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"]
        numbers = [b[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        expected.append((i, *numbers, failed, not failed and quality >= 0.5, quality))
    expected.sort(key=repr)
    assert [g[:-1] for g in got] == [e[:-1] for e in expected]
    assert [g[-1] for g in got] == pytest.approx([e[-1] for e in expected], abs=1e-6)


def test_awkward_rows(awkward):
    df = awkward(TEXTS).withColumnRenamed("words", "votes")
    judged = q.judge(df)
    assert judged.count() == len(TEXTS) + 2
    assert {"hash", "key", "score", "quality", "kept"} <= set(judged.columns) and "text" not in judged.columns
    assert q.judge(df.where("doc_id = -5")).collect() == []
