import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from eventweir.functions import envelope as env
from eventweir.operators import ingest as ops
from eventweir.sources.events import explode_batches, read_event_batches, read_event_log, to_envelope, unreadable_batches

EVENT = "type string, uuid string, host string, timestamp timestamp, data string"
NOON = dt.datetime(2011, 3, 30, 16, 10, 16)


def event(kind="Order", uuid="u", host="h", at=NOON, data='{"foo":"bar"}'):
    return (kind, uuid, host, at, data)


def found(table, *event_values):
    df = env.validate_envelope(table([event_values], EVENT))
    return [(v["field"], v["message"]) for v in df.first()["violations"]]


def test_complete_event_has_no_violation(table):
    assert found(table, *event()) == []


def test_each_missing_field_is_reported(table):
    missing = found(table, None, None, None, None, None)
    assert missing == [(f, "is missing") for f in ["type", "uuid", "host", "timestamp", "data"]]


def test_type_must_be_alphanumeric(table):
    for bad in ["order-placed", "_order", "7up", "", "a\n", "a b"]:
        assert found(table, *event(kind=bad)) == [("type", "must be alphanumeric")], bad


def test_accept_list(table):
    df = table([event("Order"), event("Refund"), event("Refund"), event(None)], EVENT)
    assert rows(env.accept_types(df, ["Order"]), "type", "status") == [
        ("Order", "valid"),
        ("Refund", "unsupported"),
        ("Refund", "unsupported"),
        (None, "unsupported"),
    ]
    assert {r.status for r in env.accept_types(df, []).collect()} == {"valid"}
    assert env.accepted_types(" a, ,b,a ") == ["a", "b"]


def test_inbound_counts(table):
    df = table([event("Order"), event("Refund"), event("Refund")], EVENT)
    assert rows(ops.inbound_counts(df, ["Order"]), "event_type", "status", "process_type", "n_events") == [
        ("Order", "valid", "write", 1),
        ("Refund", "unsupported", "write", 2),
    ]


def test_batch_verdicts(table):
    df = table([(1, "Order"), (1, "b"), (1, "a"), (1, "b"), (2, "Order")], "batch_id int, type string")
    assert rows(ops.batch_verdicts(df, ["Order"]), "batch_id", "http_status", "message") == [
        (1, 400, "Unsupported event type(s): a, b"),
        (2, 202, None),
    ]


def test_forwarded_events_are_not_spooled(table):
    df = table([event()], EVENT)
    assert rows(ops.fan_out(df, "write"), "sink") == [("spool",), ("tap",)]
    assert rows(ops.fan_out(df, "distribute"), "sink") == [("tap",)]


def test_bucket_is_the_utc_hour_of_the_event(table):
    df = table([("Order", "2011-03-30T23:30:00-02:00")], "type string, at string")
    df = df.withColumn("timestamp", F.to_timestamp("at"))
    assert env.event_partition(df).select("date", "hour", "path").first()[:] == ("2011-03-31", "01", "Order/2011-03-31/01")


def test_property_selection(table):
    data = '{"city":"Oslo","rate":1.50,"stock":{"left":"s","city":"deep"},"tags":["x"]}'
    df = table([event(data=data)], EVENT)

    def kept(policies):
        return env.select_properties(df, policies).first()["data"]

    assert kept({"data": ["city"]}) == '{"city":"Oslo"}'
    assert kept({"data": ["stock", "tags"]}) == '{"stock":{"left":"s","city":"deep"},"tags":["x"]}'
    assert kept({"data": []}) == data
    assert kept({"elsewhere": ["city"]}) == data
    assert kept({"data": ["none"]}) == "{}"
    assert kept([("data", ["city"]), ("data", ["rate"])]) == '{"city":"Oslo"}'


def test_equality_ignores_key_order_and_offset(table):
    left = table([event(data='{"a":1,"b":{"c":2,"d":3}}')], EVENT)
    right = table([event(data='{ "b": {"d":3, "c":2}, "a":1}')], EVENT)
    assert ops.diff_events(left, right).count() == 0
    pair = left.select(F.struct("*").alias("l")).crossJoin(right.select(F.struct("*").alias("r")))
    assert pair.select(env.event_equal("l", "r")).first()[0] is True


def test_kept_values_keep_kind_and_digits(table):
    long = "9" * 42
    data = f'{{"a":1.0,"b":1e3,"c":1.10,"d":{long},"e":"x \\"1.0\\" é","f":null,"g":true,"h":[1.0,"2"],"i\\"j":"1"}}'
    df = table([(data, "plain text", "[1]")], "data string, other string, list string")
    keys = [*"abcdefgh", 'i"j']
    got = env.select_properties(df, {"data": keys, "other": keys, "list": keys}).first()
    assert json.loads(got["data"], parse_float=str, parse_int=str) == {
        "a": "1.0", "b": "1000.0", "c": "1.1", "d": long, "e": 'x "1.0" é', "f": None, "g": True, "h": ["1.0", "2"], 'i"j': "1"
    }
    assert (got["other"], got["list"]) == ("plain text", "[1]")


def test_numbers_are_equal_by_kind_and_value(table):
    long = "9" * 42
    same = [("1.0", "1.00"), ("1e1", "10.0"), ('{"a":1,"b":2}', '{"b":2, "a":1}'), ('"1.0"', '"1.0"'), (long, long), ("no json", "no json")]
    other = [("1", "1.0"), ('{"a":[1]}', '{"a":[1.0]}'), ('"1.0"', "1.0"), (long, long[:-1] + "8"), ('"1"', "1"), ("10", "1e1")]
    for pairs, want in ((same, True), (other, False)):
        df = table(pairs, "a string, b string")
        assert [r[0] for r in df.select(env.canonical_json(F.col("a")) == env.canonical_json(F.col("b"))).collect()] == [want] * len(pairs)


def test_payload_that_is_no_json_cannot_spoil_a_line(table):
    lines = table([event(data="hello world"), event(data='{"n": 1.0}'), event(data=None), event(data='1} {"x":2')], EVENT).select(env.event_line()).collect()
    assert [json.loads(r[0])["data"] for r in lines] == ["hello world", {"n": 1.0}, None, '1} {"x":2']


def test_diff_counts_repeated_events(table):
    left = table([event(), event(), event(uuid=None)], EVENT)
    right = table([event(), event(host="other")], EVENT)
    assert rows(ops.diff_events(left, right), "uuid", "host", "side", "n") == [
        ("u", "h", "left", 1),
        ("u", "other", "right", 1),
        (None, "h", "left", 1),
    ]


def test_batches_are_json_arrays(spark, table, tmp_path):
    body = """[{"type":"Order","uuid":"1","host":"h","timestamp":"2011-03-30T16:10:16.000Z","data":{"foo":"bar","n":{"x":[1]}}},
    {"type":"Order","uuid":"2","host":"h","timestamp":"not a time","data":null}]"""
    out = explode_batches(table([(7, body), (8, "[]")], "batch_id int, body string"))
    assert rows(out, "batch_id", "seq", "uuid", "timestamp", "timestamp_text", "data") == [
        (7, 0, "1", NOON, "2011-03-30T16:10:16.000Z", '{"foo":"bar","n":{"x":[1]}}'),
        (7, 1, "2", None, "not a time", None),
    ]
    (tmp_path / "a.json").write_text(body)
    assert rows(read_event_batches(spark, str(tmp_path)), "uuid") == [("1",), ("2",)]


def test_bodies_that_are_no_arrays(table):
    bodies = ["[]", '[{"type":"a"}]', "{}", "[1", '[{"type":"a"}] x', "", None]
    df = table([(b,) for b in bodies], "body string")
    assert rows(unreadable_batches(df)) == sorted([(b,) for b in bodies[2:]], key=repr)


def test_lines_survive_writing_and_reading(spark, table, folder):
    path = folder("log")
    data = '{"n":1.50,"z":1,"a":"quote \\" and ü"}'
    df = table([event(data=data, at=dt.datetime(2011, 3, 30, 16, 10, 16, 123456)), event(uuid=None, data=None)], EVENT)
    df.select(env.event_line()).write.option("compression", "gzip").text(path)
    back = read_event_log(spark, path)
    assert rows(back, "uuid", "timestamp", "data", "corrupt_line") == [
        ("u", dt.datetime(2011, 3, 30, 16, 10, 16, 123456), data, None),
        (None, NOON, None, None),
    ]


def test_broken_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type":"a","uuid":"1"}\n{"type":\n')
    assert rows(read_event_log(spark, str(tmp_path)), "type", "corrupt_line") == [("a", None), (None, '{"type":')]


def test_rows_of_a_table_as_events(table):
    df = table([(1, "x", 2.5)], "id int, name string, price double")
    out = to_envelope(df, "Sold", F.lit("2024-01-01 00:00:00"), F.col("id"), F.lit("h"), ["name", "price"])
    assert out.first()["data"] == '{"name":"x","price":2.5}'
    assert out.first()["uuid"] == "1"


def test_one_json_value(table):
    lines = {
        '{"a":1}': True,
        '{"a":1,"a":2}': True,
        "5": True,
        "null": True,
        '{"type":': False,
        '{"a":1} xyz': False,
        '1,"w":2': False,
        "1] x": False,
        "1} x": False,
        "1,2": False,
        "'a'": False,
        "": False,
    }
    df = table([(k,) for k in lines], "v string").select("v", env.one_json_value(F.col("v")).alias("ok"))
    assert {r.v: r.ok for r in df.collect()} == lines


def test_spool_counts_since_cleared(table):
    df = table([event("a"), event("a", at=dt.datetime(2012, 1, 1)), event("b")], EVENT)
    assert rows(ops.spool_counts(df)) == [("a", 2, 0), ("b", 1, 0)]
    cleared = F.lit("2011-03-30 16:10:16").cast("timestamp")
    assert rows(ops.spool_counts(df, cleared)) == [("a", 1, 0)]


def test_records_per_file_rounds_up(table):
    df = table([("a", "x" * 9), ("a", "x" * 9), ("a", "x" * 9)], "k string, line string")
    assert rows(ops.records_per_file(df, 25, ["k"])) == [("a", 3, 30, 3)]
