import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventweir.functions.uris import audit_uri_list, parse_qos
from eventweir.operators import routing as ops
from eventweir.operators.joins import join_small
from eventweir.functions.transfer import subfolders
from eventweir.plans.flow_table import FlowTable
from eventweir.sources.taps import read_discovery, read_static_taps

FLOWS = "event_type string, flow_id string, destinations array<string>, qos_enabled boolean, last_known bigint"
SPECS = "event_type string, flow_id string, uri string, qos string, last_known bigint"
STATIC = "flow_key string, uris string, qos_delivery string"
PROPS = "properties map<string,string>"


def at(n):
    return F.lit(n).cast("bigint")


def announce(**properties):
    return ({k.replace("__", "."): v for k, v in properties.items()},)


def test_https_is_preferred_and_http_only_when_allowed(table):
    df = table(
        [
            announce(eventType="a", flowId="1", http="http://x:80", https="https://x:443"),
            announce(eventType="a", flowId="2", http="http://x:80"),
            announce(eventType="a", flowId="3", https="https://bad|uri", http="http://y"),
        ],
        PROPS,
    )
    assert rows(read_discovery(df, at(5)), "flow_id", "uri") == [("1", "https://x:443")]
    assert rows(read_discovery(df, at(5), allow_http=True)) == [
        ("a", "1", "https://x:443", "best_effort", 5),
        ("a", "2", "http://x:80", "best_effort", 5),
        ("a", "3", "http://y", "best_effort", 5),
    ]


def test_unusable_announcements_are_skipped(table):
    df = table(
        [
            announce(flowId="1", https="https://x"),
            announce(eventType="", flowId="1", https="https://x"),
            announce(eventType="a", https="https://x"),
            announce(eventType="a", flowId="", https="https://x"),
            announce(eventType="a", flowId="1"),
        ],
        PROPS,
    )
    assert read_discovery(df, at(5), True).count() == 0


def test_qos_words(table):
    df = table([(None,), ("retry",), ("bestEffort",)], "w string")
    assert rows(df.select(parse_qos(F.col("w")))) == [("best_effort",), ("best_effort",), ("retry",)]
    for bad in ["RETRY", "best_effort", ""]:
        with pytest.raises(PySparkException, match="unknown delivery quality"):
            table([(bad,)], "w string").select(parse_qos(F.col("w"))).collect()


def test_static_taps(table):
    df = table([(" a @ f ", "http://x, ,http://y,http://x", None), ("b@g", "https://z", "retry")], STATIC)
    assert rows(read_static_taps(df, at(1))) == [
        ("a", "f", "http://x", "best_effort", 1),
        ("a", "f", "http://y", "best_effort", 1),
        ("b", "g", "https://z", "retry", 1),
    ]


@pytest.mark.parametrize(
    "key, reason",
    [
        ("@daily", "cannot be empty"),
        ("clicks@", "cannot be empty"),
        ("@", "cannot be empty"),
        ("clicks-hourly", "single @"),
        ("clicks@hourly@eu", "single @"),
        (None, "single @"),
    ],
)
def test_bad_static_keys(table, key, reason):
    with pytest.raises(PySparkException, match=reason):
        read_static_taps(table([(key, "http://x", None)], STATIC), at(1)).collect()


@pytest.mark.parametrize("uris", ["", " , ", None, "http://a|b", "gopher://taps.test/in", "no/scheme", "https://ok,mailto:x"])
def test_bad_static_uris(table, uris):
    with pytest.raises(PySparkException, match="(?i)uri"):
        read_static_taps(table([("a@b", uris, None)], STATIC), at(1)).collect()


def test_specs_of_a_flow_merge_and_retry_sticks(table):
    static = table([("a", "1", "http://s", "best_effort", 1)], SPECS)
    found = table([("a", "1", "http://d", "retry", 9), ("a", "1", "http://s", "best_effort", 9)], SPECS)
    cached = table([("b", "1", "http://c", "best_effort", 4)], SPECS)
    flows = ops.build_flows(ops.all_tap_specs(static, found, cached))
    assert rows(flows, "event_type", "flow_id", "destinations", "qos_enabled", "last_known") == [
        ("a", "1", ["http://d", "http://s"], True, 9),
        ("b", "1", ["http://c"], False, 4),
    ]


def test_vanished_flows_are_kept_for_a_while(table):
    old = table([("a", "1", ["http://x", "http://y"], True, 100), ("a", "2", ["http://z"], False, 100)], FLOWS)
    found = table([("a", "2", "http://new", "best_effort", 150)], SPECS)
    kept = [("a", "1", "http://x", "retry", 100), ("a", "1", "http://y", "retry", 100)]
    assert rows(ops.retain_cached_flows(old, found, at(150), 60)) == kept
    assert rows(ops.retain_cached_flows(old, found, at(159), 60)) == kept
    assert rows(ops.retain_cached_flows(old, found, at(160), 60)) == []
    assert rows(ops.retain_cached_flows(old, found, at(101), 0)) == []


def test_flow_changes(table):
    old = [("a", f, ["u1", "u2"], False, 1) for f in ["keep", "target", "qos", "gone"]]
    new = [
        ("a", "keep", ["u2", "u1"], False, 2),
        ("a", "target", ["u1"], False, 2),
        ("a", "qos", ["u1"], True, 2),
        ("a", "new", ["u1"], True, 2),
    ]
    diff = ops.diff_flows(table(old, FLOWS), table(new, FLOWS))
    assert rows(diff, "flow_id", "action") == [
        ("gone", "TERMINATE"),
        ("keep", "KEEP"),
        ("new", "CREATE"),
        ("qos", "RECREATE"),
        ("target", "RETARGET"),
    ]


def test_events_go_to_every_flow_of_their_type(table):
    events = table([("a", "1"), ("b", "2"), ("c", "3"), (None, "4")], "type string, uuid string")
    flows = table([("a", "x", ["u"], False, 1), ("a", "y", ["u"], True, 1), ("b", "x", ["u"], False, 1)], FLOWS)
    assert rows(ops.route_events(events, flows), "uuid", "flow_id", "qos_enabled") == [
        ("1", "x", False),
        ("1", "y", True),
        ("2", "x", False),
    ]


def test_large_side_tables_join_alike(table):
    large = table([("a", i) for i in range(50)] + [("z", 1)], "k string, n int")
    small = table([("a", "x"), ("a", "y"), ("b", "x")], "k string, v string")
    for how in ["inner", "left"]:
        fits = join_small(large, small, ["k"], ["n"], how)
        too_large = join_small(large, small, ["k"], ["n"], how, max_bytes=0, salts=3)
        assert "Broadcast" in fits._jdf.queryExecution().optimizedPlan().toString() or fits.count()
        assert rows(fits, "k", "n", "v") == rows(too_large, "k", "n", "v")


def test_uri_audit(table):
    uris = ["http://taps.test/in box", "gopher://taps.test/in", "HTTP://ok", "http://ok", "no/scheme", "gopher://taps.test/in"]
    df = table([("f", u) for u in uris] + [("g", "https://ok")], "flow_id string, uri string")
    assert rows(ops.audit_tap_uris(df), "uri", "problem") == [
        ("gopher://taps.test/in", "scheme"),
        ("http://taps.test/in box", "syntax"),
        ("no/scheme", "scheme"),
    ]
    assert rows(ops.audit_flows(df)) == [("f", False, 1, 2), ("g", True, 0, 0)]
    message = (
        "Invalid URIs: Invalid syntax: http://taps.test/in box; Invalid scheme: gopher://taps.test/in, no/scheme"
    )
    assert rows(ops.audit_messages(ops.audit_tap_uris(df))) == [("f", message)]
    lists = table([(uris,), ([],), (["no/scheme"],)], "uris array<string>")
    verdicts = lists.select(audit_uri_list(F.col("uris"), ["http", "https"]).alias("a")).collect()
    assert [v.a.ok for v in verdicts] == [False, True, False]
    assert verdicts[0].a.message == message
    anything = lists.select(audit_uri_list(F.col("uris"), []).alias("a")).collect()
    assert [v.a.ok for v in anything] == [False, True, True]


def test_flow_table_keeps_its_last_version(spark, table, folder):
    announced = [announce(eventType="a", flowId="1", https="https://x")]
    flows = FlowTable(spark, folder("flows"), lambda: table(announced, PROPS), table([("s@1", "http://s", None)], STATIC), 0, ttl=100)
    assert rows(flows.flows()) == []
    assert rows(flows.refresh(10), "event_type", "destinations") == [("a", ["https://x"]), ("s", ["http://s"])]
    assert rows(flows.changes(), "event_type", "action") == [("a", "CREATE"), ("s", "CREATE")]

    announced[0] = announce(eventType="a", flowId="1", https="https://x", qos__delivery="nonsense")
    announced.append(announce(eventType="b", flowId="1", https="https://x"))
    before = rows(flows.flows())
    assert rows(flows.refresh(20)) == before
    assert flows.last_error is not None

    announced[:] = [announce(eventType="b", flowId="1", https="https://x")]
    assert rows(flows.refresh(30), "event_type", "last_known") == [("a", 10), ("b", 30), ("s", 0)]
    assert rows(flows.refresh(110), "event_type", "last_known") == [("b", 110), ("s", 0)]

    # A restart goes on from the stored version.
    again = FlowTable(spark, flows.root, lambda: table([], PROPS), table([("s@1", "http://s", None)], STATIC), 0)
    assert rows(again.flows(), "event_type") == [("b",), ("s",)]


def test_old_versions_are_removed(spark, table, folder):
    static = table([("s@1", "http://s", None)], STATIC)
    flows = FlowTable(spark, folder("flows"), lambda: table([], PROPS), static, 0, keep=2)
    for now in range(4):
        flows.refresh(now)
    assert flows.last_error is None
    assert subfolders(flows.root) == ["version=000000003", "version=000000004"]
    # Both versions that changes are told from are there.
    assert rows(flows.flows(), "event_type") == rows(flows.changes(), "event_type") == [("s",)]
