import datetime as dt
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventweir.functions.envelope import TYPE_PATTERN
from eventweir.plans.combine import CombineConfig, run_combine
from eventweir.plans.flow_table import FlowTable
from eventweir.plans.ingest import hourly_counts, hourly_partition_counts, post
from eventweir.sinks.spool import read_spool_lines
from eventweir.sources.events import read_event_log, stream_event_lines, stream_events
from eventweir.streaming.pipelines import delivery_tap, routed_table_tap, run_ingest, stream_backlog

PROPS = "properties map<string,string>"
STATIC = "flow_key string, uris string, qos_delivery string"


def arrive(path, name, *events):
    """A batch of (type, uuid, hour) comes in as a JSON array."""
    os.makedirs(path, exist_ok=True)
    body = [{"type": t, "uuid": u, "host": "h", "timestamp": f"2024-01-01T{h:02d}:30:00Z", "data": {"n": u}} for t, u, h in events]
    with open(f"{path}/{name}.json", "w") as f:
        json.dump(body, f)


def ingest(spark, folder_path, accepted, spool, tap=None, **options):
    query = run_ingest(
        stream_events(spark, f"{folder_path}/in", max_files=1),
        f"{folder_path}/checkpoint",
        accepted,
        spool,
        tap,
        trigger={"availableNow": True},
        **options,
    )
    query.awaitTermination()


def test_stream_spools_what_the_batch_job_counts(spark, folder):
    path, spool = folder("stream"), folder("spool")
    arrive(f"{path}/in", "1", ("a", "1", 0), ("b", "2", 0), ("x", "3", 0))
    arrive(f"{path}/in", "2", ("a", "4", 0), ("a", "5", 1))
    ingest(spark, path, ["a", "b"], spool)
    spooled = read_spool_lines(spark, spool).groupBy("event_type", "date", "hour").agg(F.count("*").alias("n_events"))
    batch = read_event_log(spark, f"{path}/in")
    assert rows(spooled) == rows(hourly_partition_counts(batch, ["a", "b"]))
    assert rows(spooled) == [("a", "2024-01-01", "00", 2), ("a", "2024-01-01", "01", 1), ("b", "2024-01-01", "00", 1)]


def test_stream_goes_on_after_a_restart(spark, folder):
    path, spool = folder("stream"), folder("spool")
    arrive(f"{path}/in", "1", ("a", "1", 0))
    ingest(spark, path, [], spool)
    arrive(f"{path}/in", "2", ("a", "2", 0))
    ingest(spark, path, [], spool)
    assert read_spool_lines(spark, spool).count() == 2


def test_forwarded_events_reach_taps_but_not_the_spool(spark, folder):
    path, spool, seen = folder("stream"), folder("spool"), []
    arrive(f"{path}/in", "1", ("a", "1", 0))
    ingest(spark, path, [], spool, lambda events, n: seen.extend(rows(events, "uuid")), process_type="distribute")
    assert seen == [("1",)]
    assert not os.path.exists(spool)


def test_each_micro_batch_sees_the_current_flows(spark, table, folder):
    path, out = folder("stream"), folder("routed")
    announced = [({"eventType": "a", "flowId": "1", "https": "https://x"},)]
    flows = FlowTable(spark, folder("flows"), lambda: table(announced, PROPS), table([("b@1", "http://s", None)], STATIC), 0)
    tap = routed_table_tap(flows, out, lambda: 100)
    arrive(f"{path}/in", "1", ("a", "1", 0), ("b", "2", 0))
    ingest(spark, path, [], folder("spool"), tap)
    announced.append(({"eventType": "a", "flowId": "2", "https": "https://y"},))
    arrive(f"{path}/in", "2", ("a", "3", 0))
    ingest(spark, path, [], folder("spool"), tap)
    assert rows(spark.read.parquet(out), "uuid", "flow_id") == [("1", "1"), ("2", "1"), ("3", "1"), ("3", "2")]


def test_lost_batches_are_sent_again(spark, table, folder):
    path, root, up = folder("stream"), folder("delivery"), folder("up")
    announced = [({"eventType": "a", "flowId": f, "https": f"https://{f}"},) for f in "xy"]
    flows = FlowTable(spark, folder("flows"), lambda: table(announced, PROPS), table([("b@z", "http://z", None)], STATIC), 0)

    def transport(uri, headers, lines):
        if uri == "https://x" and not os.path.exists(up):
            return 503
        return 202 if lines else 400

    tap = delivery_tap(flows, transport, root, lambda: 100, max_batch=2, capacity=4, retry_delay=0)

    def log(n):
        found = spark.read.parquet(f"{root}/attempts/batch={n:09d}")
        return rows(found.where("flow_id = 'x'"), "again", "batch_id", "status_code", "n_events", "first_batch", "dropped_messages")

    def waiting(n):
        found = spark.read.parquet(f"{root}/waiting/batch={n:09d}")
        return [(r[0], r[1], json.loads(r[2])["uuid"]) for r in rows(found, "flow_id", "seq", "line")]

    arrive(f"{path}/in", "1", ("a", "1", 0), ("a", "2", 0), ("a", "3", 0), ("b", "9", 0))
    ingest(spark, path, [], folder("spool"), tap)
    assert log(0) == [(False, 0, 503, 2, True, 0), (False, 1, 503, 1, True, 2)]
    assert waiting(0) == [("x", 0, "1"), ("x", 1, "2"), ("x", 2, "3")]

    arrive(f"{path}/in", "2", ("a", "4", 0), ("a", "5", 0))
    ingest(spark, path, [], folder("spool"), tap)
    assert log(1)[0] == (False, 0, 503, 2, True, 6)
    assert waiting(1) == [("x", 0, "1"), ("x", 1, "2"), ("x", 2, "3"), ("x", 3, "4")]
    assert rows(spark.read.parquet(f"{root}/drops/batch=000000001")) == [("a", "x", 1)]

    open(up, "w").close()
    arrive(f"{path}/in", "3", ("a", "6", 0))
    ingest(spark, path, [], folder("spool"), tap)
    assert log(2) == [(False, 0, 202, 1, False, 0), (True, 0, 202, 2, True, 8), (True, 1, 202, 2, False, 0)]
    assert waiting(2) == []
    state = spark.read.parquet(f"{root}/state/batch=000000002")
    assert rows(state, "flow_id", "established", "dropped") == [("x", ["https://x"], 0), ("y", ["https://y"], 0), ("z", ["http://z"], 0)]
    taken = spark.read.parquet(f"{root}/attempts").where("flow_id = 'y'")
    assert rows(taken.groupBy("status_code").agg(F.sum("n_events").alias("n"))) == [(202, 6)]


def test_nothing_that_waits_is_dropped(spark, table, folder):
    path, root = folder("stream"), folder("delivery")
    flows = FlowTable(spark, folder("flows"), lambda: table([], PROPS), table([("a@x", "http://x", None)], STATIC), 0)
    tap = delivery_tap(flows, lambda uri, headers, lines: 503, root, lambda: 100, max_batch=2, retry_delay=0)
    for n in range(3):
        arrive(f"{path}/in", str(n), *[("a", f"{n}{i}", 0) for i in range(3)])
        ingest(spark, path, [], folder("spool"), tap)
    assert spark.read.parquet(f"{root}/waiting/batch=000000002").count() == 9
    assert not os.path.exists(f"{root}/drops")


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.write(text)


def body(*events):
    return [dict({"type": "a", "uuid": "1", "host": "h", "timestamp": "2024-01-01T00:00:00Z", "data": {"n": 1}}, **e) for e in events]


def test_what_cannot_be_stored_is_kept_apart(spark, folder):
    path, spool, reports = folder("stream"), folder("spool"), folder("reports")
    write(f"{path}/in", "1", json.dumps(body({"uuid": "ok"}, {"uuid": "x", "type": "other"}), indent=2))
    write(f"{path}/in", "2", "[{")
    faulty = [{"data": "hello world"}, {"data": None}, {"timestamp": "soon"}, {"timestamp": None}, {"type": None}, {"data": [1]}]
    write(f"{path}/in", "3", "\n".join(json.dumps(body(e)) for e in faulty) + "\n" + json.dumps(body({"uuid": "line"})[0]))
    ingest(spark, path, ["a"], spool, reports=reports)

    lines = [json.loads(r["value"]) for r in read_spool_lines(spark, spool).collect()]
    assert sorted(line["uuid"] for line in lines) == ["line", "ok"] and all(line["data"] == {"n": 1} for line in lines)
    assert sorted(os.listdir(f"{spool}/event_type=a")) == ["date=2024-01-01"]
    rejects = spark.read.parquet(f"{reports}/rejects").select(F.explode("problems").alias("p")).select("p.*")
    assert rows(rejects) == [
        ("body", "is no JSON array"), ("data", "is missing"), ("data", "is no JSON object"), ("data", "is no JSON object"),
        ("timestamp", "is missing"), ("timestamp", "is unreadable"), ("type", "is missing"),
    ]
    counts = spark.read.parquet(f"{reports}/counts").groupBy("status").agg(F.sum("n_events").alias("n"))
    assert rows(counts) == [("unsupported", 2), ("valid", 7)]
    verdicts = spark.read.parquet(f"{reports}/verdicts")
    assert rows(verdicts.where("http_status = 400"), "n_events", "message") == [
        (1, "Unsupported event type(s): null"), (2, "Unsupported event type(s): other")
    ]


def test_without_reports_faulty_events_stop_the_stream(spark, folder):
    path = folder("stream")
    write(f"{path}/in", "1", json.dumps(body({"data": "hello"})))
    with pytest.raises(Exception, match="cannot be stored"):
        ingest(spark, path, [], folder("spool"))


def test_a_refused_micro_batch_stores_and_delivers_nothing(spark, folder):
    path, spool, seen = folder("stream"), folder("spool"), []
    write(f"{path}/in", "1", json.dumps(body({}, {"data": "hello"})))
    for _ in range(2):
        with pytest.raises(Exception, match="cannot be stored"):
            ingest(spark, path, [], spool, lambda events, n: seen.extend(rows(events, "uuid")))
    assert seen == [] and not os.path.exists(spool)


def test_spool_files_of_a_stream_are_rolled_by_bytes(spark, folder):
    path, spool = folder("stream"), folder("spool")
    arrive(f"{path}/in", "1", *[("a", str(i), 0) for i in range(50)])
    ingest(spark, path, [], spool, target_bytes=1000)
    assert len([f for _, _, fs in os.walk(spool) for f in fs if f.endswith(".snappy")]) > 3
    assert read_spool_lines(spark, spool).count() == 50


def test_type_pattern_is_a_choice(spark, folder):
    path, spool, reports = folder("stream"), folder("spool"), folder("reports")
    write(f"{path}/in", "1", json.dumps(body({"type": "order-placed"})))
    ingest(spark, path, [], spool, reports=reports)
    assert read_spool_lines(spark, spool).count() == 1
    path = folder("stream")
    write(f"{path}/in", "1", json.dumps(body({"type": "order-placed"})))
    ingest(spark, path, [], spool, reports=reports, type_pattern=TYPE_PATTERN)
    assert read_spool_lines(spark, spool).count() == 1


def test_large_files_are_read_by_line(spark, folder):
    path, spool = folder("stream"), folder("spool")
    write(f"{path}/in", "1", json.dumps(body({})) + "\nnot json\n" + json.dumps(body({})[0]))
    out = folder("out")
    stream = stream_event_lines(spark, f"{path}/in").writeStream.option("checkpointLocation", f"{path}/checkpoint")
    stream.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    assert rows(spark.read.parquet(out), "uuid", "corrupt_body") == [("1", None), ("1", None), (None, "not json")]


def test_backlog_goes_from_batch_to_batch(spark, folder):
    path, out = folder("stream"), folder("backlog")
    for n, count in enumerate([5, 9, 1]):
        arrive(f"{path}/in", str(n), *[("a", str(i), 0) for i in range(count)])
        os.utime(f"{path}/in/{n}.json", (1000 + n, 1000 + n))
        routed = stream_events(spark, f"{path}/in", max_files=1).withColumn("flow_id", F.col("type"))
        ticks = stream_backlog(routed, capacity=10, max_batch=3)
        writer = ticks.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("a", 0, 5, 0, 3, 2), ("a", 1, 8, 1, 3, 7), ("a", 2, 1, 0, 3, 5)]


def test_hours_are_never_closed(spark, folder):
    """Counts on a stream include events of hours long past."""
    path = folder("stream")
    arrive(f"{path}/in", "1", ("a", "1", 5))
    arrive(f"{path}/in", "2", ("a", "2", 0), ("a", "3", 5))
    counts = hourly_counts(stream_events(spark, f"{path}/in", max_files=1))
    running = counts.writeStream.outputMode("complete").format("memory").queryName("late_counts")
    running.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("late_counts")) == [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 05:00:00", 2)]


def test_late_events_are_combined_by_the_next_pass(spark, folder):
    path = folder("stream")
    config = CombineConfig(folder("staging"), folder("combined"), folder("manifest"))
    at = dt.datetime(2024, 1, 2)
    arrive(f"{path}/in", "1", ("a", "1", 0), ("a", "2", 1))
    ingest(spark, path, [], config.staging_root)
    run_combine(spark, config, at)
    arrive(f"{path}/in", "2", ("a", "3", 0))
    ingest(spark, path, [], config.staging_root)
    run_combine(spark, config, at)
    lines = spark.read.option("recursiveFileLookup", True).text(config.target_root)
    hour = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d\d)\.small", 1)
    assert rows(lines.select(hour.alias("hour"), F.get_json_object("value", "$.uuid").alias("uuid"))) == [("00", "1"), ("00", "3"), ("01", "2")]


def test_a_failing_sink_does_not_stop_the_others(table):
    seen = []

    def fail(_):
        raise OSError("full")

    with pytest.raises(ExceptionGroup) as raised:
        post(table([("a",)], "type string"), {"spool": fail, "tap": lambda df: seen.extend(rows(df))})
    assert seen == [("a",)] and len(raised.value.exceptions) == 1
