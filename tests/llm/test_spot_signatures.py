import re

from pyspark.sql import functions as F

from eventweir.llm import spot_signatures as s

COMMON = set(s.ANCHORS.split())


def chains(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for i, w in enumerate(words):
        content = [v for v in words[i + 1 :] if v not in COMMON][: s.CHAIN]
        if w in COMMON and len(content) == s.CHAIN:
            out.add(" ".join([w, *content]))
    return out or ({text} if text else set())


TEXTS = [
    "The cat of the house sat, and the dog ran to a far place. La niña y el perro.",
    "the the of cat dog",
    "no common here",
    "the end",
    "",
    None,
    "!!!",
    "the cat of the house sat",
    "Éa the çb of d1\nthe x y",
]


def test_signatures(table):
    docs = table(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = docs.select("doc_id", s.signatures(F.col("text")).alias("found")).collect()
    for i, found in rows:
        want = table([(c,) for c in chains(TEXTS[i])], "c string").select(F.hash("c")).collect()
        assert found == sorted(w[0] for w in want), TEXTS[i]


def test_fingerprints_of_edited_and_next_texts(table):
    rows = [(i * 700 - 1000, t) for i, t in enumerate(TEXTS)]
    docs = table(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in s.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for place, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(place + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, b = chains(text), chains(edited), chains(after)
        row = got[doc_id]
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (row["n_chars"], row["edited"]) == (len(text), edited)
        assert (row["near_edited"], row["near_next"]) == (jaccard(a, e), jaccard(a, b))


def test_next_within_and_across_ranges(table):
    ids = [5, 6, 7, 600, 601, 5000, 10**12, None]
    docs = table([(i, f"the text{i} is {i}") for i in ids], "doc_id bigint, text string")
    rows, window = s.with_next(docs, "text", "doc_id", min_width=3)
    found = rows.withColumn("after", F.lead("text").over(window)).where("follower = 0").collect()
    order = [None, *sorted(i for i in ids if i is not None)]
    assert {r["id"]: r["after"] for r in found} == {a: f"the text{b} is {b}" for a, b in zip(order, [*order[1:], None], strict=True)}


def test_one_document_repeated_rows_and_none(table):
    one = s.fingerprints(table([(1, "the cat sat")], "doc_id bigint, text string")).collect()
    assert one[0]["near_next"] == 1.0
    twice = s.fingerprints(table([(1, "the cat sat", 1)] * 3, "doc_id bigint, text string, follower int")).collect()
    assert [r["near_next"] for r in twice] == [1.0] * 3
    assert s.fingerprints(table([], "doc_id bigint, text string")).collect() == []


def test_strings(table):
    found = table([([-1, 0, 255],), ([],)], "found array<int>").select(s.as_text(F.col("found"))).collect()
    assert [f[0] for f in found] == ["ffffffff00000000000000ff", ""]


def test_links_between_sets(table):
    sets = [list(range(10)), list(range(10)), [*range(9), 99], list(range(8)), list(range(20, 45)), [*range(20, 43), 77], [], [1]]
    found = table(list(enumerate(sets)), "doc_id bigint, found array<int>")
    links, members = s.near_links(found, 0.8)
    rep = dict(members.collect())
    assert rep == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7}
    want = set()
    for a in set(rep.values()):
        for b in set(rep.values()):
            x, y = set(sets[a]), set(sets[b])
            if a < b and len(x & y) >= 0.8 * len(x | y):
                want.add((a, b, len(x & y) / len(x | y)))
    assert {tuple(r) for r in links.collect()} == want
