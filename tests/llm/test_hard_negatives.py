import math
import random

import pytest
from pyspark.sql import functions as F

from eventweir.llm import hard_negatives as h

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, is_anchor, m=h.Mining()):
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, label, [math.floor(m.scale * x) for x in v]))
    out = []
    for i, label, v in usable:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in usable if j != i]
        scored.sort()
        for s, j, _ in [x for x in scored if x[2] == label][: m.positives]:
            fits = [x for x in scored if x[2] != label and m.low * -s <= 100 * -x[0] <= m.high * -s][: m.negatives]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fits)]
    return sorted(out)


def found(table, rows, every, m=h.Mining(), schema=SCHEMA):
    mined = h.mine(table(rows, schema), F.col("vec_id") % every == 0, m)
    return sorted(tuple(r) for r in mined.drop("anchor_row").collect())


def made(seed, n, width=6, labels=3, values=9):
    """Few distinct components, so that ties are many."""
    r = random.Random(seed)
    return [(i, r.randrange(labels), [r.randrange(-2, values) / 64 for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(table, seed):
    rows = made(seed, 150)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert expected and found(table, rows, 10) == expected


@pytest.mark.parametrize("m", [h.Mining(2, 3, 0, 100), h.Mining(8, 2, 50, 60), h.Mining(5, 10, 30, 90, block=2)])
def test_other_windows_and_small_blocks(table, m):
    rows = made(5, 120)
    assert found(table, rows, 6, m) == brute(rows, lambda i: i % 6 == 0, m)


def test_one_label_with_most_rows_and_negative_scores(table):
    rows = [(i, 0 if i % 3 else i % 5, [x - 0.1 for x in v]) for i, _, v in made(8, 120)]
    assert found(table, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_compaction_changes_nothing(table, monkeypatch):
    monkeypatch.setattr(h.Slots.__init__, "__defaults__", (20,))
    slots = h.Slots(2, 2, 3)
    r = random.Random(1)
    rows = [(r.randrange(2), r.randrange(2), r.randrange(6), i) for i in range(300)]
    import numpy as np

    for at in range(0, 300, 7):
        slots.add(*np.array(rows[at : at + 7], np.int64).T)
    got = slots.compact().T.tolist()
    expected = []
    for cell in range(4):
        own = sorted((-s, i) for a, b, s, i in rows if a * 2 + b == cell)[:3]
        expected += [[cell, -s, i] for s, i in own]
    assert got == expected


def test_rows_that_take_no_part(table):
    nan, inf = float("nan"), float("inf")
    rows = made(2, 60) + [(100, None, [1.0] * 6), (110, 0, None), (120, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (130, 0, [nan] * 6), (140, 0, [inf] * 6)]
    rows += [(None, 0, [1.0] * 6), (150, 0, []), (160, 1, [0.1]), (170, 1, [0.1] * 9)]
    assert found(table, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_repeated_rows_and_anchors(table):
    rows = made(3, 60)
    rows = rows + rows[5:12] + [rows[10]]
    mined = h.mine(table(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in mined.drop("anchor_row").collect()) == brute(rows, lambda i: i % 10 == 0)
    assert mined.where("anchor_id = 10").select("anchor_row").distinct().count() == 3


def test_empty_and_clashing(table):
    names = ["anchor_row", "anchor_id", "positive_id", "rank", "negative_id", "score", "slot", "id", "vector"]
    assert found(table, [], 10) == []
    assert found(table, [(10, 1, [1.0])], 10) == []
    rows = made(4, 40)
    wide = [(*row, *["x"] * len(names)) for row in rows]
    schema = SCHEMA + "".join(f", `{name}` string" for name in names)
    assert found(table, wide, 10, schema=schema) == brute(rows, lambda i: i % 10 == 0)


def test_large_components(table):
    rows = [(i, i % 2, [1e5 + i, 3e5 - i]) for i in range(20)]  # beyond 53 bits
    assert found(table, rows, 10, h.Mining(scale=512)) == brute(rows, lambda i: i % 10 == 0, h.Mining(scale=512))
    with pytest.raises(Exception, match="too large"):
        found(table, [(i, i % 2, [1e30]) for i in range(20)], 10)
