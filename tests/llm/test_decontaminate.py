import random
import re

from eventweir.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), len(found), sorted(found), bool(hit)


def check(table, texts, items, schema="item_id bigint, text string"):
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    for row in d.contamination(docs, table(items, schema)).collect():
        assert tuple(row)[2:] == brute(texts[row["doc_id"]], items), row


def test_planted_passages(table, words):
    items = [(i, words(100 + i, n, 30)) for i, n in enumerate([25, 10, 11, 9, 3, 2, 1])] + [(10, words(100, 25, 30)), (11, None), (12, ""), (13, "?!")]
    r = random.Random(1)
    texts = [words(i, 80, 30) for i in range(25)]
    for i in range(25):
        item = r.choice(items[:8])[1].split(" ")
        cut = r.randrange(len(item))
        texts[i] += " " + " ".join(item[cut : cut + 15]).upper().replace(" ", "\n-- ") + " " + words(i + 50, 10, 30)
    check(table, [*texts, None, "", "..", "w1", " ".join(["w1"] * 40), items[0][1] * 3], items)


def test_window_at_both_ends_and_repeats(table):
    items = [(1, "a b a b a b a b a b a b"), (2, "x y"), (2, "x z"), (3, "x y")]
    check(table, ["a b a b a b a b a b", "b a b a b a b a b a", "x y", "y x", "q x y x z", "É x y"], items)


def test_large_benchmark_is_shuffled(table, words, monkeypatch):
    from eventweir.operators import joins

    monkeypatch.setattr(joins.join_small, "__defaults__", ("inner", 0, 4))
    items = [(i, words(i, 14, 12)) for i in range(6)]
    check(table, [words(i, 14, 12) + " " + words(i + 3, 12, 12) for i in range(6)], items)


def test_nothing_to_compare(table, awkward):
    no_items = table([], "item_id bigint, text string")
    docs = awkward(["a b", None, ""])
    got = d.contamination(docs, no_items)
    assert {(r["n_words"], r["contaminated"]) for r in got.collect()} == {(2, False), (0, False)}
    assert got.columns == [*docs.columns, "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert d.contamination(table([], "doc_id bigint, text string"), table([(1, "a b")], "item_id int, text string")).collect() == []


def test_repeated_rows_and_rows_without_id(table):
    docs = table([(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "c")], "doc_id bigint, text string")
    got = d.contamination(docs, table([(7, "b c")], "item_id int, text string")).collect()
    assert sorted((r["text"], r["n_hit"], r["items"]) for r in got) == [("a b c", 2, ["7"])] * 3 + [("c", 0, [])]
