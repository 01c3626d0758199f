import random
import re

import pytest

from eventweir.llm import secret_scan as scan

LETTERS = "password|passwd|secret|token|api_?key"
EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in LETTERS)
KINDS = [
    ("assign", rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]
PARTS = ["password", "passwd", "PassWord", "secret", "token", "api_key", "apikey", "API", "_", "key", "=", ":", " ", "  ", '"', "'"]
PARTS += ["abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH12345678", "é", "漢", "\n", "x", "/", "-----BEGIN ", "\x00"]


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, regex, keep) in enumerate(KINDS) for m in re.finditer(regex, text or "") if keep(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def made(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_equal_to_separate_searches(table):
    texts = [*made(1500), None, "", "f" * 100_000, "AKIA" * 30_000, "token=" * 9, "secret = " + "=" * 40]
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    base = [r.kind for r in scan.BASE]
    for row in scan.scan(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["kind"] in base]
        assert got == brute(texts[row["doc_id"]]), texts[row["doc_id"]][:100]


def test_more_rules_add_spans():
    scanner = scan.Scanner(scan.BASE + scan.MORE)
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "aB3" * 8
    kinds = [scanner.rules[s["rule"]].kind for s in scanner.spans([text])[0]]
    assert kinds == ["private_key", "hosting"]


def test_lanes_do_not_matter():
    texts = made(300, seed=9)
    assert scan.Scanner(scan.BASE, lane=7).spans(texts) == scan.Scanner(scan.BASE, lane=10**6).spans(texts)


@pytest.mark.parametrize("regex", [rb"a*", rb"a\nb", rb"ab(cd)?", rb"a[^b]"])
def test_rules_that_do_not_fit_are_refused(regex):
    with pytest.raises(ValueError):
        scan.Scanner((scan.Rule("odd", regex),))


def test_minimised_automaton_is_small():
    scanner = scan.Scanner((scan.Rule("a", rb"(foo|boo)d"), scan.Rule("b", rb"[0-9]{3,}")))
    plain = [scanner.spans([t])[0] for t in ("food 1234 bood 12", "foofood", "")]
    assert [[(s["rule"], s["start"], s["end"]) for s in p] for p in plain] == [[(0, 0, 4), (1, 5, 9), (0, 10, 14)], [(0, 3, 7)], []]
    assert len(scanner.moves) <= 20


def test_columns_stay(awkward, table):
    docs = awkward(["token=abcdefghijklmnop", None])
    got = scan.scan(docs)
    assert got.columns == [c for c in docs.columns if c not in ("text", "spans")] + ["spans"]
    assert sorted(len(r["spans"]) for r in got.collect()) == [0, 1, 1, 1]
    assert scan.scan(table([], "doc_id bigint, text string")).collect() == []
