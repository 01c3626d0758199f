import random

from conftest import rows
from pyspark.sql import functions as F

from eventweir.operators import delivery as ops
from eventweir.operators.batches import batch_numbers
from eventweir.operators.routing import batch_by_flow
from eventweir.operators.joins import join_small
from eventweir.operators.running import Running, running_before
from eventweir.sinks.deliver import deliver, next_tap_state

ATTEMPTS = "flow_id string, batch_id bigint, attempt_no int, uri string, status_code int, n_events bigint"
FLOWS = "event_type string, flow_id string, destinations array<string>, qos_enabled boolean, last_known bigint"
BATCHES = "event_type string, flow_id string, batch_id bigint, pos bigint, line string"


def attempts(table, *sequence):
    """One flow's attempts: (batch, status) or (batch, status, tap, events)."""
    numbers, out = {}, []
    for entry in sequence:
        batch, status, tap, n = (*entry, "t", 10)[:4] if len(entry) < 4 else entry
        numbers[batch] = numbers.get(batch, 0) + 1
        out.append(("f", batch, numbers[batch], tap, status, n))
    return table(out, ATTEMPTS)


def test_fifo_batches(table):
    df = table([("a", i * 7) for i in range(10)] + [("b", 3)], "k string, seq bigint")
    out = batch_numbers(df, ["k"], "seq", 4)
    assert [r[1:] for r in rows(out, "seq", "batch_id", "pos") if r[0] % 7 == 0] != []
    got = {(r.k, r.seq): (r.batch_id, r.pos) for r in out.collect()}
    assert got[("b", 3)] == (0, 0)
    assert [got[("a", i * 7)] for i in range(10)] == [(i // 4, i % 4) for i in range(10)]


def test_flows_of_a_type_share_batches(table):
    events = table([("a", i) for i in range(5)] + [("c", 9)], "type string, seq bigint")
    flows = table([("a", "x", ["u"], False, 1), ("a", "y", ["u"], False, 1), ("b", "x", ["u"], False, 1)], FLOWS)
    out = batch_by_flow(events, flows, "seq", 2)
    for flow in "xy":
        assert rows(out.where(F.col("flow_id") == flow), "seq", "batch_id") == [(i, i // 2) for i in range(5)]
    assert out.count() == 10


def test_running_values_do_not_depend_on_ranges(table):
    rnd = random.Random(3)
    data = [(k, p, rnd.random() < 0.2, rnd.randrange(10)) for k in "ab" for p in rnd.sample(range(-900, 9000), 300)]
    df = table(data, "k string, p bigint, reset boolean, v bigint")
    after_reset = F.when(F.col("reset"), F.lit(0).cast("bigint")).otherwise(F.col("v"))
    wanted = {
        "total": Running(F.col("v")),
        "largest": Running(F.col("v"), "max"),
        "since": Running(after_reset, reset=F.col("reset")),
    }
    for bits in (2, 5, 20):
        for key in "ab":
            total, largest, since = 0, None, 0
            out = running_before(df.where(F.col("k") == key), ["k"], "p", wanted, bits=bits)
            for r in sorted(out.collect(), key=lambda r: r.p):
                assert (r.total, r.largest, r.since) == (total, largest, since)
                total, since = total + r.v, 0 if r.reset else since + r.v
                largest = r.v if largest is None else max(largest, r.v)


def test_outcomes(table):
    df = attempts(table, (1, 202), (2, 503), (2, None), (2, 204, "u", 10), (3, 404), (3, 202), (4, 503), (4, None), (5, 302))
    assert rows(ops.delivery_outcome(df), "batch_id", "status", "uri", "attempts") == [
        (1, "delivered", "t", 1),
        (2, "delivered", "u", 3),
        (3, "rejected", "t", 1),
        (4, "lost", None, 2),
        (5, "lost", None, 1),
    ]


def dropped(df, drops=None):
    return [r[2] for r in rows(ops.dropped_header(df, drops), "batch_id", "attempt_no", "dropped_messages")]


def test_drops_are_reported_until_a_success(table):
    drops = table([("f", 1, 10)], "flow_id string, batch_id bigint, n_dropped bigint")
    ok = attempts(table, (1, 202), (2, 202))
    assert dropped(ok) == [0, 0]
    assert dropped(ok, drops) == [10, 0]
    failing = attempts(table, (1, 503), (1, None), (1, 202), (2, 202))
    assert dropped(failing, drops) == [10, 10, 10, 0]


def test_lost_and_rejected_events_count_as_dropped(table):
    df = attempts(table, (1, 503, "t", 3), (2, 404, "t", 4), (3, 503, "t", 1), (3, 200, "t", 1), (4, 202, "t", 1))
    assert dropped(df) == [0, 3, 7, 7, 0]


def first(df, epochs=None):
    return [r[2] for r in rows(ops.first_batch_flag(df, epochs), "batch_id", "attempt_no", "first_batch")]


def test_first_batch_until_the_tap_takes_one(table):
    df = attempts(table, (1, 503), (2, 404), (3, None), (4, 202), (5, 202), (6, 503))
    assert first(df) == [True, True, True, True, False, False]


def test_first_batch_again_when_the_tap_comes_back(table):
    df = attempts(table, (1, 202), (2, 202), (3, 202), (4, 202), (5, 202, "u", 1))
    epochs = table([("f", "t", 3)], "flow_id string, uri string, batch_id bigint")
    assert first(df, epochs) == [True, False, True, False, True]


def test_outbound_counts(table):
    schema = "event_type string, flow_id string, uri string, status string, n_events bigint"
    outcomes = table([("a", "f", "u", "delivered", 3), ("a", "f", "u", "delivered", 4), ("a", "f", None, "lost", 5)], schema)
    drops = table([("a", "f", 2), ("a", "g", 0)], "event_type string, flow_id string, n_dropped bigint")
    assert rows(ops.outbound_counts(outcomes, drops), "uri", "status", "n_events") == [
        ("u", "delivered", 7),
        (None, "dropped", 2),
        (None, "lost", 5),
    ]


def replay(ticks, capacity, max_batch):
    """The queue event by event."""
    queue, out = 0, []

    def offer(n):
        nonlocal queue
        taken = min(n, capacity - queue)
        queue += taken
        return taken

    for arrivals, failed, sending in ticks:
        taken = offer(arrivals)
        batch = min(max_batch, queue)
        queue -= batch
        taken += offer(sending)
        back = offer(batch) if failed else 0
        out.append((taken, arrivals + sending - taken, 0 if failed else batch, batch - back if failed else 0, queue))
    return out


def test_backlog_is_the_same_cut_into_ranges(table, monkeypatch):
    rnd = random.Random(5)
    ticks = {f: [(rnd.randrange(15), rnd.random() < 0.25, rnd.randrange(6)) for _ in range(60)] for f in "xy"}
    df = table(
        [(f, i, *t) for f in ticks for i, t in enumerate(ticks[f])],
        "flow_id string, tick int, arrivals int, failed boolean, arrivals_sending int",
    )
    for bits in (2, 16):
        monkeypatch.setattr(ops, "BACKLOG_BITS", bits)
        for capacity, batch in [(20, 8), (5, 9)]:
            got = ops.bounded_backlog(df, capacity, batch)
            for f in ticks:
                mine = rows(got.where(F.col("flow_id") == f).drop("flow_id"))
                assert [r[1:] for r in sorted(mine)] == replay(ticks[f], capacity, batch)


def test_newest_are_dropped_at_capacity(table):
    df = table([("f", 1, 5)], "flow_id string, tick int, arrivals int")
    assert rows(ops.bounded_backlog(df, 3, 2)) == [("f", 1, 3, 2, 2, 0, 1)]


def test_metrics_reset_on_read(table):
    df = table([("f", 1, 5, 2, 0), ("f", 2, 9, 9, 1), ("f", 3, 9, 9, 1)], "flow_id string, read_no int, enqueued bigint, dequeued bigint, dropped bigint")
    assert rows(ops.backlog_metrics(df)) == [("f", 1, 5, 2, 0, 3), ("f", 2, 4, 7, 1, 0), ("f", 3, 0, 0, 0, 0)]


def sent(table, transport, flows, batches, **options):
    out = deliver(table(batches, BATCHES), table(flows, FLOWS), transport, retry_delay=0, **options)
    return rows(out, "flow_id", "batch_id", "attempt_no", "uri", "status_code", "n_events", "first_batch", "dropped_messages")


def test_every_tap_is_tried_before_a_batch_is_lost(table):
    flows = [("a", "f", ["u1", "u2"], False, 1)]

    def refuse(uri, headers, lines):
        if uri == "u1":
            raise ConnectionError
        return 503

    got = sent(table, refuse, flows, [("a", "f", 1, 0, "x"), ("a", "f", 1, 1, "y")])
    assert sorted((r[3], r[4], r[5]) for r in got) == [("u1", None, 2), ("u2", 503, 2)]
    assert [r[2] for r in got] == [1, 2]


def test_flows_with_retries_get_more_rounds(table):
    batch = [("a", "f", 1, 0, "x")]
    assert len(sent(table, lambda *_: 503, [("a", "f", ["u"], True, 1)], batch, retry_count=3)) == 4
    assert len(sent(table, lambda *_: 503, [("a", "f", ["u"], False, 1)], batch, retry_count=3)) == 1


def test_rejection_and_success_end_a_batch(table):
    flows = [("a", "f", ["u1", "u2"], True, 1)]
    batch = [("a", "f", 1, 0, "x")]
    for status in (200, 404):
        got = sent(table, lambda *_: status, flows, batch)
        assert [r[4] for r in got] == [status]


def test_headers(table, spark):
    flows = [("a", "f", ["u"], False, 1)]
    state = table([("a", "f", [], 7)], "event_type string, flow_id string, established array<string>, dropped bigint")

    def checking(uri, headers, lines):
        marks = headers.get("X-QoS", [])
        return 200 + len(marks) + (10 if "droppedMessages=7" in marks else 0)

    got = sent(table, checking, flows, [("a", "f", 1, 0, "x"), ("a", "f", 2, 0, "y")], tap_state=state)
    assert [(r[1], r[4], r[6], r[7]) for r in got] == [(1, 212, True, 7), (2, 200, False, 0)]


def test_lines_arrive_in_order(table):
    def in_order(uri, headers, lines):
        return 200 if lines == [f"line {i}" for i in range(4)] else 500

    batch = [("a", "f", 1, i, f"line {i}") for i in (2, 0, 3, 1)]
    assert [r[4] for r in sent(table, in_order, [("a", "f", ["u"], False, 1)], batch)] == [200]


def test_state_goes_from_one_delivery_to_the_next(table):
    flows = table([("a", "f", ["u", "v"], False, 1), ("a", "g", ["u"], False, 1)], FLOWS)
    schema = "event_type string, flow_id string, batch_id bigint, attempt_no int, uri string, status_code int, n_events bigint"
    one = table([("a", "f", 1, 1, "u", 202, 5), ("a", "f", 2, 1, "v", 404, 6), ("a", "g", 1, 1, "u", 503, 2)], schema)
    state = next_tap_state(one, flows)
    assert rows(state) == [("a", "f", ["u"], 6), ("a", "g", [], 2)]
    two = table([("a", "g", 2, 1, "u", 503, 3)], schema)
    state = next_tap_state(two, flows, state)
    assert rows(state) == [("a", "f", ["u"], 6), ("a", "g", [], 5)]
    three = table([("a", "g", 3, 1, "u", 200, 3), ("a", "f", 3, 1, "v", 200, 3)], schema)
    assert rows(next_tap_state(three, flows, state)) == [("a", "f", ["u", "v"], 0), ("a", "g", ["u"], 0)]


def test_a_mark_ends_with_the_first_success_of_a_tap(table):
    """Batches fail over to the same tap; only the first of them tells it so."""
    flows = [("a", "f", ["a", "b", "down"], False, 1)]
    batches = [("a", "f", i, 0, f"line {i}") for i in range(12)]
    got = sent(table, lambda uri, headers, lines: 503 if uri == "down" else 202, flows, batches)
    marked = [(r[3], r[4]) for r in got if r[6] and r[3] != "down"]
    assert sorted(marked) == [("a", 202), ("b", 202)]
    assert {r[1] for r in got if r[4] == 202} == set(range(12))


def test_rounds_wait_outside_of_tasks_and_send_what_is_lost(table, folder):
    path, waits = folder("calls"), []

    def transport(uri, headers, lines):
        """Takes a batch when it comes for the third time."""
        import os

        os.makedirs(f"{path}/{lines[0]}/{len(os.listdir(f'{path}/{lines[0]}')) if os.path.exists(f'{path}/{lines[0]}') else 0}")
        return 202 if len(os.listdir(f"{path}/{lines[0]}")) == 3 or lines[0] == "x" else 503

    flows = table([("a", "f", ["u"], True, 1), ("b", "g", ["v"], False, 1)], FLOWS)
    batches = table([("a", "f", 1, 0, "x"), ("a", "f", 2, 0, "y"), ("b", "g", 1, 0, "z")], BATCHES)
    out = rows(deliver(batches, flows, transport, retry_count=5, retry_delay=7.5, wait=waits.append))
    assert waits == [7.5, 7.5]
    assert [(r[1], r[2], r[3], r[5]) for r in out] == [("f", 1, 1, 202), ("f", 2, 1, 503), ("f", 2, 2, 503), ("f", 2, 3, 202), ("g", 1, 1, 503)]


def test_what_waits_for_a_round_is_not_reported_as_dropped(table):
    flows = [("a", "f", ["u"], True, 1), ("a", "g", ["u"], False, 1)]
    batches = [("a", f, i, 0, "bad" if i == 0 else "good") for f in "fg" for i in range(3)]
    got = sent(table, lambda uri, headers, lines: 503 if lines[0] == "bad" else 202, flows, batches, retry_count=2)
    reports = {(r[0], r[1], r[2]): r[7] for r in got}
    assert reports[("f", 1, 1)] == 0 and reports[("g", 1, 1)] == 1
    assert [r[2] for r in got if r[0] == "f" and r[1] == 0] == [1, 2, 3]


def test_only_tables_of_flows_and_taps_are_broadcast(table, monkeypatch):
    """What is due again or waits grows with the batches, so no machine holds all of it."""
    from eventweir.sinks import deliver as module

    sizes = []

    def recorded(large, small, *rest):
        sizes.append(small.count())
        return join_small(large, small, *rest)

    monkeypatch.setattr(module, "join_small", recorded)
    batches = [("a", "f", i, 0, f"line {i}") for i in range(30)]
    got = sent(table, lambda *_: 503, [("a", "f", ["u"], True, 1)], batches, retry_count=1)
    assert sorted((r[1], r[2]) for r in got) == [(i, n) for i in range(30) for n in (1, 2)]
    assert max(sizes) == 1
