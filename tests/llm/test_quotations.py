from eventweir.llm import quotations as q

THREAD = [
    (1, 0, "alice", "Shall we meet?\nAt noon?\n\nBring the plans."),
    (1, 1, "bob", "> shall we  MEET?\n> At noon?\n\nYes."),
    (1, 2, "carol", ">> At noon?\n> Yes.\n\nI cannot."),
    (1, 3, "bob", "Something new."),
    (1, 4, "alice", "> I cannot.\nPity."),
    (1, 5, "dan", "> Something new.\n> unknown words\nIndeed."),
    (1, 6, "eve", "> nobody said this\nHm."),
    (2, 0, "bob", "> Shall we meet?\nOther conversation."),
    (2, 1, "bob", "I say so."),
    (2, 2, "bob", "> I say so.\n> I say so."),
    (3, 0, "x", None),
    (3, 1, "x", ""),
    (None, 0, "y", "ground"),
    (None, 1, "y", ">ground\nabove"),
    (4, None, "z", "> lost"),
]


def made(table):
    return table([(*r, i) for i, r in enumerate(THREAD)], "conv_id bigint, turn bigint, role string, text string, thread int")


def test_replies_and_threads(table):
    rows = q.conversations(made(table)).collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["n_passages"], r["n_linked"]) for r in rows}
    assert got == {
        (1, 0): (None, 0, 0, 0),
        (1, 1): (0, 0, 1, 1),
        # Level one, "Yes.", comes before the deeper quote.
        (1, 2): (1, 0, 2, 2),
        (1, 3): (None, 3, 0, 0),
        (1, 4): (2, 0, 1, 1),
        # Not found as a whole, but by its first line.
        (1, 5): (3, 3, 1, 1),
        (1, 6): (None, 6, 1, 0),
        (2, 0): (None, 0, 1, 0),
        (2, 1): (None, 1, 0, 0),
        (2, 2): (1, 1, 1, 1),
        (3, 0): (None, 0, 0, 0),
        (3, 1): (None, 1, 0, 0),
        (None, 0): (None, 0, 0, 0),
        (None, 1): (0, 0, 1, 1),
        (4, None): (None, None, 0, 0),
    }


def test_order_and_texts(table):
    rows = [r for r in q.conversations(made(table)).collect() if r["conv_id"] == 1]
    assert [r["turn"] for r in rows] == [0, 1, 2, 4, 3, 5, 6]
    assert rows[1]["own_text"] == "\nYes." and rows[2]["own_text"] == "\nI cannot."


def test_long_chain_of_replies(table):
    rows = [(1, i, f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(40)]
    got = q.conversations(table(rows, "conv_id bigint, turn bigint, text string")).collect()
    assert {r["thread"] for r in got} == {0} and [r["reply_to"] for r in got] == [None, *range(39)]


def test_repeated_rows_and_no_rows(table):
    rows = [(1, 0, "a b"), (1, 1, "> a b\nc"), (1, 1, "> a b\nc"), (1, 1, "other")]
    got = q.conversations(table(rows, "conv_id bigint, turn bigint, text string")).collect()
    assert sorted((r["turn"], r["reply_to"], r["n_linked"]) for r in got[1:]) == [(1, 0, 0), (1, 0, 1), (1, 0, 1)]
    assert q.conversations(table([], "conv_id bigint, turn bigint, text string")).collect() == []


def test_clashing_names(table):
    names = ["its_conv", "conv", "hash", "message", "original", "c", "t", "m", "passage", "level", "body", "row", "own", "first_turn"]
    rows = [(*r, *names) for r in THREAD]
    df = table(rows, "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"{n} string" for n in names))
    plain = {(r["conv_id"], r["turn"], r["reply_to"], r["own_text"]) for r in q.conversations(made(table)).collect()}
    found = q.conversations(df).collect()
    assert {(r["conv_id"], r["turn"], r["reply_to"], r["own_text"]) for r in found} == plain
    assert all(r[n] == n for r in found for n in names)


def test_turns_with_quotes(table):
    rows = [(1, t, f"Turn {t}.\n\nIt has {t} lines.", t) for t in range(7)] + [(2, 1, "alone", 0), (3, 0, None, 0), (3, 1, "x", 0), (None, 1, "y", 0), (4, None, "z", 0)]
    df = table(rows, "conv_id bigint, turn bigint, text string, thread int")
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in q.with_quotes(df).collect()}
    assert texts[1, 2] == ">> Turn 0.\n>> \n>> It has 0 lines.\n> Turn 1.\n> \n> It has 1 lines.\nTurn 2.\n\nIt has 2 lines."
    assert [texts[k] for k in [(1, 3), (2, 1), (3, 0), (3, 1), (None, 1), (4, None)]] == ["Turn 3.\n\nIt has 3 lines.", "alone", None, "x", "y", "z"]
    found = {(r["conv_id"], r["turn"]): r for r in q.conversations(q.with_quotes(df)).collect()}
    assert [(found[1, t]["reply_to"], found[1, t]["thread"], found[1, t]["n_passages"], found[1, t]["n_linked"]) for t in range(7)] == [
        (None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 2), (None, 3, 0, 0), (3, 3, 1, 1), (4, 3, 2, 2), (None, 6, 0, 0),
    ]
    assert all(r["own_text"] == (next(x[2] for x in rows if x[:2] == k) or "") for k, r in found.items())
