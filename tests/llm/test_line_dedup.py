import re
from collections import Counter

from eventweir.llm import line_dedup
from eventweir.session import scratch_path


def brute(texts, min_docs, min_chars=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for lines in split for k in {key(line) for line in lines} if len(k) >= min_chars)
    kept = [[line for line in lines if count[key(line)] < min_docs] for lines in split]
    return [("\n".join(k), len(s), len(s) - len(k)) for k, s in zip(kept, split, strict=True)]


def test_lines_of_enough_documents_go(table):
    texts = [f"Own {i}\n  SHARED line\t\nshared line\n{'rare' if i < 2 else i}\n" for i in range(6)]
    texts += [None, "", "\n\n", "shared LINE", "É\né", "x\r\n shared line \r", "\x1cshared line"]
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    got = line_dedup.dedup_lines(docs, min_docs=4, batches=3)
    got = {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert got == dict(enumerate(brute(texts, 4)))


def test_null_text_stays_null_and_columns_stay(awkward):
    docs = awkward(["a\nb", None, "", "long " * 50_000, "b"])
    got = line_dedup.dedup_lines(docs, min_docs=4)
    assert got.columns == [*docs.columns, "n_dropped"]
    rows = got.collect()
    assert len(rows) == 7
    # "a" and "b" stand in the first row, its repetition, the row without an id, and "b" in one more.
    assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] in (0, 4, None)) == [
        ("", 1, 1), ("a", 2, 1), ("a", 2, 1), ("a", 2, 1)
    ]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]


def test_empty_table(table):
    assert line_dedup.dedup_lines(table([], "doc_id bigint, text string")).collect() == []


def test_runs_merge_and_skip_settled_keys(spark, table):
    runs = line_dedup.LineRuns(spark, scratch_path(spark, "runs"), min_docs=3, buckets=3, fanout=2)
    for batch in range(5):
        rows = [(k, k, 2 if k < 10 else 1) for k in range(batch * 4, batch * 4 + 12)]
        runs.add(table(rows, "h1 bigint, h2 bigint, n_docs bigint"))
    assert sum(map(len, runs.levels)) <= 3
    total = Counter()
    for batch in range(5):
        for k in range(batch * 4, batch * 4 + 12):
            total[k] += 2 if k < 10 else 1
    assert sorted(r["h1"] for r in runs.frequent().collect()) == sorted(k for k, n in total.items() if n >= 3)
    runs.drop()
