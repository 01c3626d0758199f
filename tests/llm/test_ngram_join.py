import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweir.llm import ngram_join as n
from eventweir.session import settings


def shingles(text, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def linked(a, b, similarity=80):
    return bool(a and b) and 100 * len(a & b) >= similarity * len(a | b)


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if linked(sets[a], sets[b]):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in sets.items()}


def edited(text, r, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def test_components(table, words):
    r = random.Random(2)
    texts = []
    for size in (4, 5, 6, 8, 12, 30, 90, 300):
        for base in range(4):
            text = words(size * 10 + base, size, 5000)
            texts += [text, text.upper(), *(edited(text, r, s) for s in (0.01, 0.02, 0.03, 0.04, 0.05)), " ".join(text.split(" ")[: size - size // 6])]
    passage = words(1, 60)
    texts += [passage + " " + words(1000 + i, r.choice([15, 20, 30, 60])) for i in range(80)]
    texts += ["", None, " \t\n", "a", "a", "A\x0b", "a b c d", "a b c d", "a " * 50]
    rows = list(enumerate(texts))
    got = {tuple(x) for x in n.components(table(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_crowded_pieces_are_indexed_again(table, words, monkeypatch):
    monkeypatch.setattr(n, "MANY", 3)
    r = random.Random(8)
    passage = words(1, 50)
    texts = [passage + " " + words(i, r.choice([10, 14, 20])) for i in range(60)]
    texts += [edited(t, r, 0.02) for t in texts]
    rows = list(enumerate(texts))
    assert {tuple(x) for x in n.components(table(rows, "doc_id bigint, text string")).collect()} == brute(rows)


def test_crowd_of_texts_that_nearly_link(table, words, monkeypatch):
    """Many texts whose similarities lie on both sides of the threshold."""
    monkeypatch.setattr(n, "MANY", 5)
    r = random.Random(12)
    text = words(3, 90)
    texts = [edited(text, r, share) for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.09) for _ in range(14)]
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert 5 < len({c for _, _, c in expected}) < 95
    assert {tuple(x) for x in n.components(table(rows, "doc_id bigint, text string")).collect()} == expected


def test_crowd_that_hardly_links_is_not_paired_with_itself(table, words, monkeypatch):
    """Most pairs share a rare shingle, but hardly more are verified than link."""
    monkeypatch.setattr(n, "MANY", 5)
    verified, verify = [], n.verified
    monkeypatch.setattr(n, "verified", lambda pairs, *a: (verified.append(pairs.count()), verify(pairs, *a))[1])
    r = random.Random(21)
    text = words(4, 150)
    near = [edited(text, r, 0.02) for _ in range(30)]
    rows = list(enumerate([edited(t, r, 0.005) for t in near for _ in range(4)]))
    expected = brute(rows)
    assert 20 < len({c for _, _, c in expected}) < 120
    assert {tuple(x) for x in n.components(table(rows, "doc_id bigint, text string")).collect()} == expected
    assert sum(verified) < 8 * len(rows), verified


def test_what_is_stored_does_not_take_a_file_for_each_shuffle_partition(spark, table, words, monkeypatch):
    """With many shuffle partitions, small tables and few pairs need few tasks, in every step."""
    monkeypatch.setattr(n, "MANY", 5)
    most, files, store = 2 * spark.sparkContext.defaultParallelism, {}, n.written_table

    def written(df, name):
        out = store(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(n, "written_table", written)
    r = random.Random(31)
    text = words(6, 90)
    rows = list(enumerate(edited(text, r, share) for share in (0.01, 0.03, 0.05, 0.08) for _ in range(12)))
    with settings(spark, spark__sql__shuffle__partitions=str(4 * most), spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert {tuple(x) for x in n.components(table(rows, "doc_id bigint, text string")).collect()} == brute(rows)
    dealt = {"pieces", "near-pairs"}  # their rows are counted only when they are stored
    assert {"pairs", "sets", "per-label", "often", "verified", *dealt} <= set(files)
    assert all(count <= most for name, count in files.items() if name not in dealt), files


def test_crowds_are_paired_in_blocks(table):
    """Every pair that can link meets, whatever the sizes of blocks, buffers and batches."""
    join, r = n.Join(), np.random.default_rng(5)
    sets = {c: (40 + c % 7, c % 3, c % 5, *r.integers(0, 2**6, 4).tolist(), *[0] * (n.SKETCH - 4)) for c in range(90)}
    pieces = [(key, c, *s) for key, upto in ((1, 90), (2, 30), (3, 2), (4, 1)) for c, s in sets.items() if c < upto]
    expected = set()
    for a, b in itertools.combinations(sets, 2):
        (n_a, rank_a, label_a, *s_a), (n_b, rank_b, label_b, *s_b) = sets[a], sets[b]
        bits = sum((x ^ y).bit_count() for x, y in zip(s_a, s_b, strict=True))
        fits = 180 * min(n_a - rank_a, n_b - rank_b) >= 80 * (n_a + n_b)
        if label_a != label_b and fits and 180 * bits <= 20 * (n_a + n_b):
            expected.add((a, b))
    assert 0 < len(expected) < 2000
    rows = table(pieces, ", ".join(f"{name} bigint" for name in ("key", "cls", "n", "rank", "label", *n.SKETCHES)))
    counts = rows.groupBy("key").agg(F.count("*").alias("n_rows"))
    for block, most, waiting in ((1000, 200_000, 20_000), (20, 50, 10), (7, 1, 1), (90, 10**6, 40)):
        dealt = n.cells(rows, counts.where(F.col("n_rows") > block), block)
        held = dealt.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0]
        assert held <= 4 * block + 20 or block == 1000
        found = n.near_pairs(dealt, join, most, waiting).distinct().collect()
        assert {tuple(x) for x in found} == expected and len(found) == len(expected), block


@pytest.mark.parametrize("similarity", [60, 80, 95])
def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(spark, similarity):
    join, r = n.Join(similarity=similarity), np.random.default_rng(similarity)
    rows, linked = [], []
    for size in (1, 5, 40, 200, 900, 3000):
        a = np.unique(r.integers(0, 2**64, size, np.uint64))
        for changed in {0, 1, size // 40, size // 20, size // 11, size // 9, size // 5, size // 2, size}:
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 2**64, changed, np.uint64)]))
            common = len(np.intersect1d(a, b))
            linked.append(100 * common >= similarity * (len(a) + len(b) - common))
            numbers = np.stack(n.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])))
            rows.append((len(rows), len(a), len(b), *numbers[:, 0].tolist(), *numbers[:, 1].tolist()))
    names = ["row", "n_a", "n_b", *(f"{s}_{side}" for side in "ab" for s in n.SKETCHES)]
    alike = {x["row"]: x["alike"] for x in spark.createDataFrame(rows, names).select("row", join.alike("a", "b").alias("alike")).collect()}
    assert all(alike[i] for i, yes in enumerate(linked) if yes)
    assert any(linked) and not all(alike.values())


@pytest.mark.parametrize("similarity", [60, 80, 95])
def test_linked_sets_share_an_indexed_piece(similarity):
    join, r = n.Join(similarity=similarity), np.random.default_rng(similarity)
    checked = 0
    for size in [*range(1, 70), 127, 128, 129, 255, 256, 400, 1023, 1024, 1300]:
        a = np.unique(r.integers(0, 2**64, size, np.uint64))
        for extra in (0, 1, size // 20, size // 9, size // 5):
            for gone in (0, 1, size // 20, size // 9):
                b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**64, extra, np.uint64)]))
                common = len(np.intersect1d(a, b))
                if not len(b) or 100 * common < similarity * (len(a) + len(b) - common) or np.array_equal(a, b):
                    continue
                keys, of = join.pieces(np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (size, extra, gone)
                checked += 1
    assert checked > 50


def test_both_kinds_of_segments_are_chosen():
    kinds = [n.Join().allocation(b) for b in range(2, 14)]
    assert any(p and not e for e, p in kinds) and any(e and not p for e, p in kinds)


def test_keep_one(table, words):
    text = words(5, 60)
    rows = [(3, text), (1, text), (2, text + " more"), (4, words(6, 60)), (5, None), (6, ""), (None, text), (None, "alone here")]
    docs = table([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string")
    got = n.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 4, 5, 6, None, None]


def test_repeated_rows_and_empty_tables(table, awkward, words):
    got = n.components(awkward([words(1, 30), words(1, 30), None, "x"])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(0, 26, 0), (0, 26, 0), (1, 26, 0), (2, 0, 2), (3, 1, 3), (None, 26, 0)], key=str
    )
    assert n.components(table([], "doc_id bigint, text string")).collect() == []
    assert n.components(table([(1, None)], "doc_id bigint, text string")).collect() == [(1, 0, 1)]


def test_few_links_leave_the_labels_where_they_are(spark):
    """Labels are neither shuffled to merge them nor stored in a file for each shuffle partition."""
    size = 3000
    labels = spark.range(size).repartition(40).select(F.col("id").alias("cls"), F.col("id").alias("label"))
    links = spark.range(size).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    merged, moves = n.merge_labels(labels, links, size)
    assert moves >= size - size // 10
    assert all(r.label == r.cls // 10 * 10 for r in merged.collect())
    assert len(merged.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


def test_merging_few_links_stores_few_files(spark, monkeypatch):
    """Every file and task costs the driver memory; without links nothing is stored at all."""
    most = 2 * spark.sparkContext.defaultParallelism
    files, store = [], n.written_table

    def written(df, name):
        out = store(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(n, "written_table", written)
    size = 3000
    labels = spark.range(size).select(F.col("id").alias("cls"), F.col("id").alias("label"))
    links = spark.range(size).where("id % 3 <> 2").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with settings(spark, spark__sql__shuffle__partitions=str(2 * most), spark__sql__adaptive__coalescePartitions__enabled="false"):
        merged, _ = n.merge_labels(labels, links, size)
        assert all(r.label == r.cls // 3 * 3 for r in merged.collect())
        assert files and max(files) <= most, files
        files.clear()
        assert n.merge_labels(labels, links.where("a < 0"), size)[1] == 0 and not files


def test_stored_rows_are_counted_as_they_are_written(spark, table, words, monkeypatch):
    """A job that counts what was just stored costs the driver the memory of its plan, stages and broadcasts."""
    for name in ("count", "isEmpty"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda *_, name=name: pytest.fail(f"{name} after a write"))
    stored, store = [], n.counted_table

    def written(df, name, which=None):
        out, found = store(df, name, which)
        stored.append((name, out if which is None else out.where(which), found))
        return out, found

    monkeypatch.setattr(n, "counted_table", written)
    r = random.Random(43)
    text = words(7, 90)
    rows = list(enumerate(edited(text, r, share) for share in (0.01, 0.03, 0.05) for _ in range(8)))
    got = n.components(table(rows, "doc_id bigint, text string")).collect()
    assert {tuple(x) for x in got} == brute(rows)
    monkeypatch.undo()
    assert all(out.count() == found for _, out, found in stored), [(name, found) for name, _, found in stored]
    assert {"pieces", "sets", "verified", "labels", "often"} <= {name for name, _, _ in stored}
