import datetime as dt
import gzip
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventweir.functions import transfer
from eventweir.functions.inspection import inspect_file
from eventweir.operators import files as ops
from eventweir.plans import recover
from eventweir.session import settings, shared_root, written_table
from eventweir.sinks.spool import read_spool_lines, write_spool
from eventweir.sources.events import read_event_log
from eventweir.sources.listing import event_types, list_objects, list_partitions, with_bucket

EVENT = "type string, uuid string, host string, timestamp timestamp, data string"
GOOD = b"".join(b'{"type":"Test","uuid":"%d","timestamp":"2024-01-01T00:00:00Z"}\n' % i for i in (1, 2))


def events(table, n, kind="Test", day=1):
    return table([(kind, f"{kind}{i}", "h", dt.datetime(2024, 1, day, i % 2, 30), '{"i":%d}' % i) for i in range(n)], EVENT)


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


@pytest.mark.parametrize("codec, suffix", [("snappy", ".snappy"), ("gzip", ".gz"), ("none", ".txt"), ("zstd", ".zst")])
def test_spool_and_read_back(spark, table, folder, codec, suffix):
    root = folder("spool")
    try:
        write_spool(events(table, 10), root, max_records=3, codec=codec)
    except Exception as error:  # a codec this installation cannot write
        if codec != "zstd":
            raise
        pytest.skip(str(error)[:80])
    found = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(suffix)]
    assert len(found) == 4
    assert rows(read_spool_lines(spark, root).groupBy("event_type", "date", "hour").count()) == [
        ("Test", "2024-01-01", "00", 5),
        ("Test", "2024-01-01", "01", 5),
    ]
    assert rows(read_event_log(spark, root), "uuid") == rows(events(table, 10), "uuid")
    assert rows(ops.verify_files(spark, root), "n_records", "first_type", "status") == [
        (2, "Test", "ok"),
        (2, "Test", "ok"),
        (3, "Test", "ok"),
        (3, "Test", "ok"),
    ]


def test_a_repeated_batch_replaces_its_files(spark, table, folder):
    root = folder("spool")
    write_spool(events(table, 4), root, batch_id=1)
    write_spool(events(table, 6, day=2), root, batch_id=2)
    write_spool(events(table, 4), root, batch_id=1)
    assert read_spool_lines(spark, root).count() == 10


def test_a_hot_bucket_is_written_by_several_tasks(spark, folder):
    root = folder("spool")
    df = spark.range(60_000).select(
        F.lit("hot").alias("type"),
        F.sha2(F.col("id").cast("string"), 256).alias("uuid"),
        F.lit("h").alias("host"),
        F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"),
        F.lit("{}").alias("data"),
    )
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="512k"):
        write_spool(df, root)
    found = [f for _, _, fs in os.walk(root) for f in fs if f.endswith(".snappy")]
    assert len(found) > 3
    assert read_spool_lines(spark, root).count() == 60_000


def sizes(spark, root):
    """Lines and bytes of each file, by its folder."""
    found = spark.read.text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows(found.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes")), "n", "bytes")


@pytest.mark.parametrize("target", [400, 1500, 10**6])
def test_files_are_rolled_by_bytes(spark, table, folder, target):
    root, line = folder("spool"), 110
    many = events(table, 300).unionByName(events(table, 3, "Rare")).withColumn("at", F.monotonically_increasing_id())
    write_spool(many, root, target_bytes=target, position="at")
    total = {k: v for k, v in rows(read_spool_lines(spark, root).groupBy("event_type", "hour").agg(F.sum(F.octet_length("value") + 1).alias("n")).select(F.concat("event_type", "hour"), "n"))}
    assert len(sizes(spark, root)) == sum(-(-n // target) for n in total.values())
    large = [b for _, b in sizes(spark, root) if b > 400]
    assert all(b <= target + line for _, b in sizes(spark, root))
    assert target >= 10**6 or all(b >= target / 2 - line for b in large)
    assert rows(read_event_log(spark, root), "uuid") == rows(many, "uuid")


def test_rolled_files_keep_the_order_and_a_hot_bucket_is_cut(spark, folder):
    root = folder("spool")
    df = spark.range(20_000).repartition(7).select(
        F.lit("hot").alias("type"), F.col("id").cast("string").alias("uuid"), F.lit("h").alias("host"),
        F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"), F.lit("{}").alias("data"), "id",
    )
    write_spool(df, root, target_bytes=100_000, position="id")
    lines = spark.read.text(root).select(F.col("_metadata.file_path").alias("p"), F.get_json_object("value", "$.uuid").cast("int").alias("u"))
    files = sorted(rows(lines.groupBy("p").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count("*").alias("n")), "a", "b", "n"))
    assert len(files) > 10 and [a for a, _, _ in files] == [0, *[b + 1 for _, b, _ in files[:-1]]]
    assert all(b - a + 1 == n for a, b, n in files)
    for path, name in [(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".snappy")][:2]:
        u = [r[0] for r in spark.read.text(f"{path}/{name}").select(F.get_json_object("value", "$.uuid").cast("int")).collect()]
        assert u == sorted(u)


def test_a_repeated_batch_replaces_its_rolled_files(spark, table, folder):
    root = folder("spool")
    write_spool(events(table, 40), root, batch_id=1, target_bytes=500)
    write_spool(events(table, 4), root, batch_id=2, target_bytes=500)
    write_spool(events(table, 40), root, batch_id=1, target_bytes=500)
    assert read_spool_lines(spark, root).count() == 44


def test_corrupt_files(spark, folder):
    root = folder("staging")
    packed = gzip.compress(GOOD * 2000)
    put(root, "good.json.gz", gzip.compress(GOOD) + gzip.compress(GOOD))
    put(root, "cut.json.gz", packed[: len(packed) - 12])
    put(root, "line.json", GOOD + b'{"type":\n' + GOOD)
    put(root, "empty.json", b"")
    put(root, "no_event.json", b"[1, 2]\n")
    put(root, "sub/plain.json", GOOD + b"\n")
    put(root, "two_on_a_line.json", GOOD[:-1] + b" [1]\r\n")
    put(root, "not_a_number.json", GOOD + b"NaN\n")
    put(root, "no_time.json", b'{"type":"Test"}\n')
    put(root, "not_text.json", GOOD + b'"\xff"\n')
    put(root, "not.json.snappy", b"\x00\x00\x00\x10nonsense")
    got = {os.path.basename(r.file): (r.n_records, r.status) for r in ops.verify_files(spark, root).collect()}
    assert got["good.json.gz"] == (4, "ok")
    assert got["plain.json"] == (2, "ok")
    assert got["two_on_a_line.json"] == (3, "ok")
    assert got["line.json"] == (4, "corrupt")
    assert got["empty.json"] == (0, "corrupt")
    assert {n for n, (_, status) in got.items() if status == "corrupt"} == {
        "cut.json.gz",
        "line.json",
        "empty.json",
        "no_event.json",
        "no_time.json",
        "not_a_number.json",
        "not_text.json",
        "not.json.snappy",
    }


def test_zstd_files_are_read_through(folder):
    zstandard = pytest.importorskip("zstandard")
    root = folder("staging")
    packed = zstandard.ZstdCompressor().compress(GOOD * 50)
    assert inspect_file(put(root, "good.json.zst", packed + packed)) == (True, 200, GOOD.split(b"\n")[0].decode())
    assert inspect_file(put(root, "cut.json.zst", packed[:-5]))[0] is False
    assert inspect_file(put(root, "not.json.zst", b"nonsense"))[0] is False


def test_quarantine_moves_only_corrupt_files(spark, folder):
    root = folder("root")
    for place in "ab":
        put(root, f"staging/{place}/same.json", b"{")
    put(root, "staging/good.json", GOOD)
    verdicts = ops.verify_files(spark, f"{root}/staging")
    moved = ops.quarantine_corrupt(written_table(verdicts, "verdicts"), f"{root}/failed")
    assert moved.count() == 2
    assert len(os.listdir(f"{root}/failed")) == 2
    assert rows(ops.verify_files(spark, f"{root}/staging"), "status") == [("ok",)]


def test_moving_twice_does_no_harm(folder):
    root = folder("root")
    path = put(root, "a.json", GOOD)
    target = transfer.move_into(path, f"{root}/failed")
    assert transfer.move_into(path, f"{root}/failed") == target
    assert not os.path.exists(path)


def test_listing(spark, folder):
    root = folder("root")
    put(root, "click/2024-01-01/00/a.json", GOOD)
    put(root, "click/2024-01-02/00/b.json", GOOD * 2)
    put(root, "view/2024-01-01/23/c.json", b"")
    put(root, "top.json", b"x")
    put(root, "click/2024-01-01/00/_SUCCESS", b"")
    put(root, "click/2024-01-01/00/.a.json.crc", b"x")
    assert rows(list_objects(spark, root, recursive=False), "name", "size") == [("top.json", 1)]
    found = with_bucket(list_objects(spark, root).where("name <> 'top.json'"))
    assert rows(found, "event_type", "date", "hour", "name", "size") == [
        ("click", "2024-01-01", "00", "a.json", len(GOOD)),
        ("click", "2024-01-02", "00", "b.json", 2 * len(GOOD)),
        ("view", "2024-01-01", "23", "c.json", 0),
    ]
    assert rows(list_partitions(found, "event_type")) == [("click",), ("view",)]
    assert rows(list_partitions(found, "date")) == [("click", "2024-01-01"), ("click", "2024-01-02"), ("view", "2024-01-01")]
    assert event_types(root) == ["click", "view"]
    assert rows(list_objects(spark, root, ["2024-01-01"]), "name") == [("a.json",), ("c.json",)]
    assert rows(list_objects(spark, root, ["2023-01-01"]), "name") == []
    assert rows(list_objects(spark, root, ["2024-01-01"], types=["view"]), "name") == [("c.json",)]
    assert rows(list_objects(spark, root, types=["click"]), "name") == [("a.json",), ("b.json",), ("top.json",)]
    one, other = (list_objects(spark, root, etag=e).where("name = 'a.json'").first()["etag"] for e in ("md5", "version"))
    assert one != other and len(one) == 32


def test_bucket_of_a_recovered_file(table):
    at = dt.datetime(2024, 1, 1, 5)
    lines = table([("f", 3, "b", at), ("f", 1, "a", at), ("g", 9, "c", None)], "file string, line_no int, type string, timestamp timestamp")
    assert rows(ops.file_partition(lines)) == [("f", "a", "2024-01-01", "05"), ("g", "c", None, None)]


def test_lines_are_in_file_order(spark, folder):
    root = folder("root")
    put(root, "a.json", b"".join(b"%d\n" % i for i in range(5000)))
    put(root, "b.json.gz", gzip.compress(b"x\ny\n"))
    lines = ops.file_lines(spark, root).where(F.col("file").endswith("a.json")).orderBy("line_no").collect()
    assert [int(r.value) for r in lines] == list(range(5000))


LOG = "file string, attempt int, outcome string, event_type string, duration_ms bigint, finished_at bigint"


def test_upload_stats(table):
    log = table(
        [
            ("f", 1, "failure", "a", 5, 10),
            ("f", 2, "success", "a", 7, 400),
            ("g", 1, "corrupt", "a", 1, 10),
            ("h", 1, "success", "b", 2, 10),
        ],
        LOG,
    )
    assert rows(ops.upload_stats(log), "metric", "event_type", "status", "n", "total_ms") == [
        ("processed_files", "a", "uploaded", 1, None),
        ("processed_files", "b", "uploaded", 1, None),
        ("processed_files", "unknown", "corrupt", 1, None),
        ("processed_time", "a", None, 2, 12),
        ("processed_time", "b", None, 1, 2),
        ("upload_attempts", "a", "failure", 1, None),
        ("upload_attempts", "a", "success", 1, None),
        ("upload_attempts", "b", "success", 1, None),
    ]


def test_files_are_retried_each_period(table):
    log = table([("f", 1, "failure", "a", 1, 10), ("g", 1, "failure", "a", 1, 10), ("g", 2, "success", "a", 1, 310), ("h", 1, "corrupt", "a", 1, 10)], LOG)
    columns = ("file", "state", "attempts", "due_at", "is_due")
    assert rows(ops.retry_ledger(log, F.lit(309)), *columns) == [
        ("f", "retry", 1, 310, False),
        ("g", "uploaded", 2, None, False),
        ("h", "failed", 1, None, False),
    ]
    assert rows(ops.retry_ledger(log, F.lit(310)), *columns)[0] == ("f", "retry", 1, 310, True)


def test_scratch_follows_the_session_setting(spark, table):
    stored = written_table(table([(1,)], "n int"), "x")
    assert all(f.startswith("file://" + shared_root(spark)) for f in stored.inputFiles())


def staged_files(folder):
    """A recovery over good, broken and empty files."""
    root = folder("recovery")
    for name in ("a/one.json", "b/one.json"):
        put(root, f"staging/{name}", GOOD)
    put(root, "staging/odd.json.gz", gzip.compress(b'{"type":"a/b=\\u00e9","uuid":"1","timestamp":"2024-01-02T03:00:00Z","data":{}}\n'))
    put(root, "staging/cut.json.gz", gzip.compress(GOOD * 500)[:-9])
    put(root, "staging/line.json", GOOD + b"{\n")
    put(root, "staging/empty.json", b"")
    return recover.Recovery(*[f"{root}/{name}" for name in ("staging", "target", "failed", "log")], period=300)


def refusing(word):
    def attempt(source, target):
        if word in source:
            raise OSError("the store is away")
        transfer.put_file(source, target)

    return attempt


def with_put(config, put):
    return recover.Recovery(config.staging, config.target, config.failed, config.root, config.period, put)


def outcomes(done):
    return [("/".join(f.split("/staging/")[1:]), n, o) for f, n, o in rows(done, "file", "attempt", "outcome")]


def test_left_over_files_are_stored_failed_or_wait(spark, folder):
    config = staged_files(folder)
    first = recover.recover_files(spark, with_put(config, refusing("/a/")), 1000)
    assert outcomes(first) == [
        ("a/one.json", 1, "failure"),
        ("b/one.json", 1, "success"),
        ("cut.json.gz", 1, "corrupt"),
        ("empty.json", 1, "corrupt"),
        ("line.json", 1, "corrupt"),
        ("odd.json.gz", 1, "success"),
    ]
    assert "the store is away" in first.where("outcome = 'failure'").first()["message"]
    assert len(os.listdir(config.failed)) == 3
    assert rows(read_spool_lines(spark, config.target), "event_type", "date", "hour") == [
        ("Test", "2024-01-01", "00"),
        ("Test", "2024-01-01", "00"),
        ("a/b=\u00e9", "2024-01-02", "03"),
    ]
    assert rows(recover.waiting_files(spark, config), "attempts", "due_at") == [(1, 1300)]

    # Not due yet; a new file goes at once.
    put(config.staging, "c/one.json", GOOD)
    assert outcomes(recover.recover_files(spark, config, 1299)) == [("c/one.json", 1, "success")]
    assert rows(recover.waiting_files(spark, config), "attempts", "due_at") == [(1, 1300)]
    # Again and again without limit.
    assert outcomes(recover.recover_files(spark, with_put(config, refusing("/a/")), 1300)) == [("a/one.json", 2, "failure")]
    assert outcomes(recover.recover_files(spark, config, 1599)) == []
    assert outcomes(recover.recover_files(spark, config, 1600)) == [("a/one.json", 3, "success")]
    assert recover.waiting_files(spark, config).count() == 0
    assert [f for _, _, found in os.walk(config.staging) for f in found] == []
    assert read_spool_lines(spark, config.target).count() == 7

    log = recover.read_attempts(spark, config)
    assert rows(log.groupBy("pass").count()) == [(1, 6), (2, 1), (3, 1), (5, 1)]
    assert rows(ops.upload_stats(log), "metric", "event_type", "status", "n") == [
        ("processed_files", "Test", "uploaded", 3),
        ("processed_files", "a/b=\u00e9", "uploaded", 1),
        ("processed_files", "unknown", "corrupt", 3),
        ("processed_time", "Test", None, 5),
        ("processed_time", "a/b=\u00e9", None, 1),
        ("upload_attempts", "Test", "failure", 2),
        ("upload_attempts", "Test", "success", 3),
        ("upload_attempts", "a/b=\u00e9", "success", 1),
    ]


def test_a_pass_that_died_is_finished_first(spark, folder):
    config = staged_files(folder)
    recover._plan(spark, config, 1, 1000)
    # It had put one file and removed it, put another, and moved a broken one.
    names = {name: f"{config.staging}/{name}" for name in ("a/one.json", "b/one.json", "line.json")}
    goal = {name: transfer.object_name(config.target, "Test", "2024-01-01", "00", path) for name, path in names.items()}
    transfer.put_file(names["a/one.json"], goal["a/one.json"])
    transfer.remove_file(names["a/one.json"])
    transfer.put_file(names["b/one.json"], goal["b/one.json"])
    transfer.move_into(names["line.json"], config.failed)
    put(config.staging, "late.json", GOOD)
    assert outcomes(recover.recover_files(spark, config, 2000)) == [("late.json", 1, "success")]
    assert {o for _, _, o in outcomes(recover.read_attempts(spark, config, 1).where("event_type = 'Test'"))} == {"success"}
    assert rows(recover.read_attempts(spark, config).groupBy("outcome").count()) == [("corrupt", 3), ("success", 4)]
    assert read_spool_lines(spark, config.target).count() == 7
    assert len(os.listdir(config.failed)) == 3


def test_a_plan_that_is_half_written_is_made_anew(spark, folder):
    config = staged_files(folder)
    recover._plan(spark, config, 1, 1000)
    os.remove(f"{config.root}/plan=000000001/_SUCCESS")
    assert len(outcomes(recover.recover_files(spark, config, 2000))) == 6
    assert recover.read_attempts(spark, config).agg(F.max("finished_at")).first()[0] == 2000


def test_nothing_staged(spark, folder):
    root = folder("none")
    config = recover.Recovery(*[f"{root}/{name}" for name in ("staging", "target", "failed", "log")])
    assert recover.read_attempts(spark, config).count() == 0
    for _ in range(4):
        assert recover.recover_files(spark, config, 0).count() == 0
    assert len([n for n in os.listdir(config.root) if n.startswith("plan=")]) == recover.KEEP


def test_folders_are_listed_by_a_bounded_number_of_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"))
    assert tasks == 4 * spark.sparkContext.defaultParallelism
