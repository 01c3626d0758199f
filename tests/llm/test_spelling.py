import random
import re
import zlib
from collections import Counter

import pytest

from eventweir.llm import spelling as s


def counts(rows, how):
    n = Counter()
    for i, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            if how.spoil:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % how.spoil == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
            if len(run) >= how.min_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= how.min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, how):
    words = counts(rows, how)
    form = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        is_form = best is not None and words[best] >= how.times * n
        form[w] = (best if is_form else None, words[best] if is_form else None, len(close))

    def root(w):
        return w if form[w][0] is None else root(form[w][0])

    return sorted((w, form[w][0] or "", root(w), n, form[w][2], form[w][1] or 0) for w, n in words.items())


def found(df, how):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in s.variants(df, how).collect())


def corpus(seed, docs=30, letters="abé"):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randrange(3, 7))) for _ in range(40)]
    weights = [1 / (i + 1) ** 2 for i in range(40)]
    return [(i, " ".join(r.choices(vocabulary, weights, k=60))) for i in range(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(table, seed):
    how = s.Spelling(min_chars=3, min_count=2, times=2, spoil=5)
    rows = corpus(seed)
    expected = brute(rows, how)
    assert sum(bool(e[1]) for e in expected) > 5
    assert found(table(rows, "doc_id bigint, text string"), how) == expected


def test_production_parameters(table):
    how = s.Spelling(spoil=31)
    rows = [(i, " ".join(["Aardvarks", "überraschung", "différence", "sentences", "sentence"] * 12)) for i in range(40)]
    expected = brute(rows, how)
    assert any(e[1] for e in expected) and found(table(rows, "doc_id bigint, text string"), how) == expected


def test_scan_pairs_once():
    words = ["aaaa", "aaa", "aab", "ab", "b", "aaab", "abab", "a"]
    rotations = sorted(((w + "$")[i:] + w[:i], 1) for w in words for i in range(len(w) + 1))
    total = Counter()
    for word, n, _, _ in s.scan(iter(rotations)):
        total[word] += n
    assert total == Counter({w: n for w in words if (n := sum(near(w, x) for x in words))})


def test_awkward_rows(spark, table, awkward):
    how = s.Spelling(min_chars=2, min_count=1, times=2)
    texts = ["one two", None, "", "Zwölf ÄÖ×÷ twelve" * 3, "x " * 5000 + "twoo " * 3, "  \n", "onetwo"]
    df = awkward(texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(df, how) == brute(rows, how)
    got = {r["word"]: r["n"] for r in s.word_counts(df, how).collect()}
    assert got == counts(rows, how)
    assert s.variants(df.where("doc_id = -1"), s.Spelling()).collect() == []


def test_long_ways_to_the_root(table):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(i, " ".join([w] * 2 ** (i + 1))) for i, w in enumerate(chain)]
    how = s.Spelling(times=2)
    assert found(table(rows, "doc_id bigint, text string"), how) == brute(rows, how)
    assert {r["root"] for r in s.variants(table(rows, "doc_id bigint, text string"), how).collect()} == {"aabbbbb"}
