import random

import numpy as np
from tokenizers import Tokenizer

from eventweir.llm import bpe, token_counts

ODD = "ab é  \x1c\x85\n\t  '’sll1²½٣<|>endoftext😀漢字​﻿-"


def samples():
    r = random.Random(5)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [*texts, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "", "a" * 3000, "don't we'll  I've 'tis", None, "the " * 9000]


def test_equal_to_the_library(table, bpe_path):
    texts, library = samples(), Tokenizer.from_file(bpe_path)
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, bpe_path), bpe_path).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want
        assert got[i]["text"] == library.decode(want, skip_special_tokens=False)


def test_forgotten_words_are_encoded_again(bpe_path):
    coder = bpe.Bpe(bpe_path, max_words=2)
    first = [coder.encode(["one two three four"])[0].tolist() for _ in range(3)]
    assert first[0] == first[1] == first[2]


def test_incomplete_bytes_decode_to_marks(table, bpe_path):
    library = Tokenizer.from_file(bpe_path)
    ids = library.encode("漢😀", add_special_tokens=False).ids
    lists = [ids[:1], ids[1:], ids[::-1], [], None]
    got = bpe.decode(table(list(enumerate(lists)), "i int, ids array<int>"), bpe_path).collect()
    for row in got:
        assert row["text"] == library.decode(row["ids"] or [], skip_special_tokens=False)


def test_columns_stay(awkward, bpe_path, table):
    docs = awkward(["a b", None, ""])
    coded = bpe.encode(docs, bpe_path)
    assert coded.columns == [c for c in docs.columns if c != "text"] + ["ids"] and coded.count() == 5
    assert bpe.decode(bpe.encode(table([], "text string"), bpe_path), bpe_path).collect() == []


def brute_counts(path, text, rule):
    coder = bpe.Bpe(path)
    ids, _ = coder.encode([text])
    raw = (text or "").encode()
    ends = [i + 1 for i, b in enumerate(raw) if b == 10]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    of_byte = [sum(e <= i for e in ends) for i in range(len(raw))]
    out, at = [[0, 0] for _ in ends], 0
    for i in ids:
        held = of_byte[at : at + int(coder.token_length[i])]
        at += len(held)
        best = held[0] if rule == "first" else max(sorted(set(held)), key=held.count)
        out[best][0] += 1
        out[best][1] += len(set(held)) > 1
    starts = [0, *ends[:-1]]
    return [(s, len(raw[a:b].decode()), *o) for s, (a, b, o) in enumerate(zip(starts, ends, out, strict=True))]


def test_section_counts(table, bpe_path):
    texts = ["one\ntwo\n\n\n three", "", None, "\n", "no end", "a\n\n\nb\n", "é漢\n\n漢", " \n \n  \n x", "x" * 5000 + "\n"]
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    for rule in token_counts.RULES:
        got = token_counts.count_sections(docs, bpe_path, rule).collect()
        for i, text in enumerate(texts):
            rows = sorted(tuple(r)[1:] for r in got if r["doc_id"] == i)
            assert rows == brute_counts(bpe_path, text, rule), (rule, text)


def test_allocation_rules():
    ends, sections = np.array([3, 7, 8]), np.array([1, 5, 8])
    assert [a.tolist() for a in token_counts.allocate(ends, sections, "most")] == [[1, 1, 2], [True, True, False]]
    assert token_counts.allocate(ends, sections, "first")[0].tolist() == [0, 1, 2]


def test_field_counts(table, bpe_path):
    rows = [(1, "a title", "a body\nof two lines"), (2, None, ""), (3, "\n\n", "x")]
    fields = table(rows, "doc_id bigint, title string, body string")
    got = sorted(tuple(r) for r in token_counts.count_fields(fields, bpe_path, ["title", "body"]).collect())
    coder = bpe.Bpe(bpe_path)
    for doc_id, title, body in got:
        of = next(r for r in rows if r[0] == doc_id)
        assert title + body == len(coder.encode(["".join((f or "") + "\n" for f in of[1:])])[0])
    assert [g[0] for g in got] == [1, 2, 3]


def test_sections_of_nothing(table, bpe_path, awkward):
    assert token_counts.count_sections(table([], "doc_id bigint, text string"), bpe_path).collect() == []
    assert token_counts.count_sections(awkward(["a\nb", None]), bpe_path).count() == 2 + 1 + 2 + 2


def test_one_pass_equals_two(awkward, bpe_path):
    df = awkward(["a b", None, "", "long words " * 3000, "é\U0001f600 <|endoftext|>"]).withColumnRenamed("words", "ids")
    two = bpe.decode(bpe.encode(df.drop("ids"), bpe_path), bpe_path)
    one = bpe.encode_and_decode(df, bpe_path, max_bytes=50)
    assert sorted(map(tuple, one.select(*two.columns).collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)


def test_a_column_named_as_the_ids_is_replaced(table, bpe_path):
    df = table([(1, "a b", "x"), (2, None, "y")], "doc_id bigint, text string, ids string")
    got = bpe.decode(bpe.encode(df, bpe_path), bpe_path).collect()
    assert sorted((r["doc_id"], r["text"], len(r["ids"])) for r in got) == [(1, "a b", 2), (2, "", 0)]
