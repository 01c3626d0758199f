import datetime as dt
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventweir.functions.locations import combined_location, location_parts, priority_class
from eventweir.functions.transfer import create_exclusive, read_small
from eventweir.operators import combine as ops
from eventweir.operators import packing
from eventweir.operators.packing import pack_first_fit
from eventweir.plans import schedule
from eventweir.plans.combine import CombineConfig, run_combine
from eventweir.schema import GROUP, MANIFEST
from eventweir.session import written_table
from eventweir.sinks.compact import compact
from eventweir.sinks.manifests import claim_groups, write_manifest, write_snapshot
from eventweir.sinks.spool import write_spool
from eventweir.sources.manifests import explode_parts, group_headers, manifest_view, read_group_documents, read_headers, read_manifests

MB = 1024 * 1024
KEYS = "event_type string, date string, hour string, size_class string"
FILES = f"{KEYS}, location string, etag string, size bigint, last_modified bigint"
HOUR = ("t", "2024-01-01", "08")


def file(name, size, etag="e", group=(*HOUR, "small")):
    return (*group, f"s3://staging/{'/'.join(group[:3])}/{name}", etag, size, 0)


def manifest(table, *objects, version=1, creator="node", updated=0):
    """Objects as lists of (name, size) of group HOUR."""
    prefix = "s3://target/t/2024-01-01/08.small"
    out = []
    for i, parts in enumerate(objects):
        sources = [(file(n, s)[4], "e", s, 0) for n, s in parts]
        out.append((*HOUR, "small", prefix, version, creator, updated, i, f"{prefix}.{i:05d}.json.snappy", updated, sources))
    return table(out, MANIFEST)


def packed(df):
    return {r.location.rsplit("/", 1)[1]: (r.ordinal, r.part_no) for r in df.collect()}


def test_worked_example(table):
    sizes = [480, 90, 250, 140, 350, 70]
    files = [file(f"f{i}", s * MB) for i, s in enumerate(sizes)]
    first = pack_first_fit(table(files, FILES), target=512 * MB)
    assert [packed(first)[f"f{i}"][0] for i in range(6)] == [0, 0, 1, 1, 1, 2]

    one = ops.next_manifest(table([], MANIFEST), first, "s3://target", "node", 100)
    assert rows(one, "ordinal", "version", "location")[2] == (2, 6, "s3://target/t/2024-01-01/08.small.00002.json.snappy")
    more = files + [file("f6", 500 * MB), file("f7", 200 * MB)]
    staged = table(more, FILES)
    fresh = ops.uncombined_objects(staged, explode_parts(one))
    numbers = group_headers(one).withColumnRenamed("n_objects", "next_ordinal")
    growing = ops.open_objects(ops.parts_status(one, staged), 512 * MB)
    second = pack_first_fit(fresh, growing, numbers, 512 * MB)
    assert packed(second) == {"f6": (2, 1), "f7": (3, 0)}

    two = ops.next_manifest(one, second, "s3://target", "other", 200)
    names = lambda r: [p.location.rsplit("/", 1)[1] for p in r.source_parts]
    got = {r.ordinal: (names(r), r.version, r.creator, r.object_updated_ts) for r in two.collect()}
    assert got == {
        0: (["f0", "f1"], 8, "other", 100),
        1: (["f2", "f3", "f4"], 8, "other", 100),
        2: (["f5", "f6"], 8, "other", 200),
        3: (["f7"], 8, "other", 200),
    }


def first_fit(files, growing, number, target):
    """File by file, looking at all objects."""
    objects, out = [list(o) for o in growing], {}
    for location, size in sorted(files):
        for o in objects:
            if o[1] < target:
                break
        else:
            o = [number, 0, 0]
            objects.append(o)
            number += 1
        out[location.rsplit("/", 1)[1]] = (o[0], o[2])
        o[1] += size
        o[2] += 1
    return out


@pytest.mark.parametrize("chunks", [None, 1, 5, 23])
def test_packing_is_first_fit_however_it_is_cut(table, chunks):
    rnd, target = random.Random(7), 100
    files, growing, numbers, wanted = [], [], [], {}
    for g, (n, k) in enumerate([(300, 0), (150, 1), (200, 5), (1, 2), (0, 3), (80, 9)]):
        group = ("t", f"2024-01-{g:02d}", "00", "small")
        mine = [file(f"g{g}-{rnd.random():.8f}", rnd.choice([1, 1, 5, 60, 130]), group=group) for _ in range(n)]
        old = [(2 * i, rnd.randrange(1, target), rnd.randrange(1, 4)) for i in range(k)]
        files += mine
        growing += [(*group, *o) for o in old]
        numbers.append((*group, 50))
        wanted |= first_fit([(f[4], f[6]) for f in mine], old, 50, target)
    rnd.shuffle(files)
    got = pack_first_fit(
        table(files, FILES),
        table(growing, f"{KEYS}, ordinal bigint, size bigint, n_parts bigint"),
        table(numbers, f"{KEYS}, next_ordinal bigint"),
        target,
        chunks,
    )
    assert packed(got) == wanted


def test_chunks_hold_a_bounded_number_of_files(table, monkeypatch):
    """Whatever Spark would make of the files' bytes: tasks hold a chunk each in Python."""
    monkeypatch.setattr(packing, "CHUNK_FILES", 50)
    stored = {}

    def recorded(df, name):
        stored[name] = written_table(df, name)
        return stored[name]

    monkeypatch.setattr(packing, "written_table", recorded)
    files = [file(f"{i:04d}", 1 + i % 7) for i in range(400)]
    assert packed(pack_first_fit(table(files, FILES), target=100)) == first_fit([(f[4], f[6]) for f in files], [], 0, 100)
    assert stored["pack"].groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 100


def test_empty_files_are_left_out_and_five_mebibytes_are_large(table):
    df = table([("a", 0), ("b", 5 * MB - 1), ("c", 5 * MB)], "n string, size bigint")
    assert rows(ops.with_size_class(df), "n", "size_class") == [("b", "small"), ("c", "large")]


def test_date_window(table):
    days = ["2024-01-16", "2024-01-17", "2024-01-31", "2024-02-01"]
    df = table([(d,) for d in days], "date string")
    assert rows(ops.date_window(df, dt.date(2024, 1, 31))) == [("2024-01-17",), ("2024-01-31",)]
    assert ops.date_window(df, dt.date(2024, 1, 31), disabled=True).count() == 4
    assert rows(ops.date_window(df, dt.date(2024, 1, 31), 1, 0)) == []
    with pytest.raises(ValueError):
        ops.date_window(df, dt.date(2024, 1, 31), 1, 1)


def test_missing_and_changed_parts(table):
    m = manifest(table, [("a", 1), ("b", 2)], [("c", 3)], [("d", 4)])
    staged = table([file("a", 1), file("c", 3), file("d", 5), file("e", 1)], FILES)
    status = ops.parts_status(m, staged)
    assert rows(status, "ordinal", "all_available", "matches", "size", "n_parts") == [
        (0, False, False, 3, 2),
        (1, True, True, 3, 1),
        (2, True, False, 4, 1),
    ]
    fresh = ops.uncombined_objects(staged, explode_parts(m))
    assert rows(fresh, "location") == [(file("e", 1)[4],)]
    assert rows(ops.open_objects(status, 10), "ordinal") == [(1,)]
    assert rows(ops.bad_manifests(status, fresh, 10), "hour") == [("08",)]
    assert ops.bad_manifests(status, fresh.limit(0), 10).count() == 0
    assert ops.bad_manifests(status, fresh, 4).count() == 0


def test_only_missing_or_stale_objects_are_rewritten(table):
    m = manifest(table, [("a", 1), ("b", 2)], [("c", 3)], [("d", 4)], [("gone", 1)])
    staged = table([file(n, s) for n, s in [("a", 1), ("b", 2), ("c", 3), ("d", 4)]], FILES)
    prefix = "s3://target/t/2024-01-01/08.small"
    targets = table([(f"{prefix}.00000.json.snappy", 3), (f"{prefix}.00001.json.snappy", 2)], "location string, size bigint")
    assert rows(ops.combine_worklist(m, staged, targets), "ordinal", "size", "target_size") == [(1, 3, 2), (2, 4, None)]


def test_writer_lease(table):
    m = manifest(table, [("a", 1)], creator="other", updated=1000)
    headers = group_headers(m)
    assert ops.writable_groups(headers, "node", 1000 + 299_999).count() == 0
    assert ops.writable_groups(headers, "node", 1000 + 300_000).count() == 1
    assert ops.writable_groups(headers, "other", 1001).count() == 1
    free = table([file("a", 1), file("b", 1, group=("new", "2024-01-01", "08", "small"))], FILES)
    assert rows(ops.in_writable_groups(free, headers, "node", 1001), "event_type") == [("new",)]


def test_version_conflicts(table):
    stored = table([(*HOUR, "small", 3, "p"), (*HOUR, "large", 3, "p")], f"{KEYS}, version bigint, location_prefix string")
    proposed = f"{KEYS}, read_version bigint, location_prefix string"
    groups = [(*HOUR, "small", 3, "p"), (*HOUR, "large", 2, "p"), ("n", "d", "h", "small", 0, "p"), ("n", "d", "h", "large", 1, "p")]
    out = ops.manifest_conflicts(stored, table(groups, proposed))
    assert rows(out, "event_type", "size_class", "status") == [
        ("n", "large", "conflict"),
        ("n", "small", "commit"),
        ("t", "large", "conflict"),
        ("t", "small", "commit"),
    ]
    with pytest.raises(PySparkException, match="location prefix changed"):
        ops.manifest_conflicts(stored, table([(*HOUR, "small", 3, "q")], proposed)).collect()


def test_mixed_objects(table):
    m = manifest(table, [("a", 1), ("b", 5 * MB)], [("c", 1), ("d", 2)])
    assert rows(ops.mixed_objects(m), "ordinal") == [(0,)]


def test_priorities(table):
    df = table([("a",), ("b",), ("c",)], "t string")
    assert rows(df.select("t", priority_class(F.col("t"), ["a"], ["b"]))) == [("a", "high"), ("b", "low"), ("c", "normal")]
    with pytest.raises(ValueError):
        priority_class(F.col("t"), ["a"], ["a"])


def test_locations(table):
    df = table([("s3://bucket/a/b/c.json",), ("s3://bucket/a/b/",), ("s3://bucket/",)], "l string")
    out = df.select(*[c.alias(n) for n, c in location_parts(F.col("l")).items()])
    assert rows(out) == [
        ("bucket", "", "s3://bucket/", None),
        ("bucket", "a/b/", "s3://bucket/a/b/", "b"),
        ("bucket", "a/b/c.json", "s3://bucket/a/b/", "c.json"),
    ]
    for bad in (".x",):
        with pytest.raises(ValueError):
            combined_location(F.col("l"), F.lit(1), bad)


def test_manifests_are_stored_by_pass(spark, table, folder):
    root = folder("manifest")
    assert read_manifests(spark, root).count() == 0
    write_manifest(manifest(table, [("a", 1)], [("b", 1)]), root, 1)
    write_manifest(manifest(table, [("a", 1), ("c", 1)], version=2), root, 2)
    got = read_manifests(spark, root)
    assert {(r.ordinal, r.version, len(r.source_parts)) for r in got.collect()} == {(0, 2, 2), (1, 1, 1)}
    assert rows(group_headers(got), "version", "n_objects") == [(2, 2)]
    assert read_manifests(spark, root, ("2024-01-02", "2024-01-03")).count() == 0
    with pytest.raises(PySparkException):
        write_manifest(manifest(table, [("a", 1)]), root, 2)
    with open(f"{root}/pass=000000000002/date=2024-01-01/broken.parquet", "w") as f:
        f.write("nonsense")
    with pytest.raises(Exception, match="broken.parquet"):
        read_manifests(spark, root).collect()


def test_group_documents_can_be_imported(spark, folder):
    root = folder("documents")
    os.makedirs(f"{root}/t/2024-01-01")
    part = {"location": "s3://staging/t/2024-01-01/08/a", "etag": "e", "size": 3, "lastModified": 4}
    document = {
        "locationPrefix": "s3://target/t/2024-01-01/08.small",
        "version": 1,
        "creator": "node",
        "updatedTimestamp": 5,
        "combinedObjects": [{"location": "s3://target/t/2024-01-01/08.small.00000.json.snappy", "updatedTimestamp": 6, "sourceParts": [part]}],
    }
    with open(f"{root}/t/2024-01-01/08.small.metadata", "w") as f:
        json.dump(document, f, indent=1)
    out = read_group_documents(spark, root)
    assert rows(explode_parts(out)) == [(*HOUR, "small", 0, document["combinedObjects"][0]["location"], 0, part["location"], "e", 3, 4)]
    assert rows(out, "version", "creator", "updated_ts", "object_updated_ts") == [(1, "node", 5, 6)]


EVENT = "type string, uuid string, host string, timestamp timestamp, data string"
AT = dt.datetime(2024, 1, 10, 12)


def events(table, *ids, kind="a", day=9):
    return table([(kind, f"{kind}-{i}", "h", dt.datetime(2024, 1, day, 8, 30), "{}") for i in ids], EVENT)


@pytest.fixture
def config(folder):
    return CombineConfig(folder("staging"), folder("combined"), folder("manifest"), group_id="g")


def combined(spark, config):
    """Uuids per combined object, in file order."""
    out = {}
    for d, _, names in os.walk(config.target_root):
        for name in names:
            if not name.startswith("."):
                lines = spark.read.text(os.path.join(d, name)).collect()
                out[os.path.relpath(os.path.join(d, name), config.target_root)] = [json.loads(r.value)["uuid"] for r in lines]
    return out


def test_combining_keeps_order_and_is_done_once(spark, table, config):
    for ids in [(1, 2), (3,), (4, 5)]:
        write_spool(events(table, *ids), config.staging_root)
    announced = []
    one = run_combine(spark, config, AT, announce=announced.append)
    assert rows(one.log, "status") == [("combined",)]
    listed = sorted(f for d, _, fs in os.walk(config.staging_root) for f in fs if f.endswith(".snappy"))
    got = combined(spark, config)
    assert list(got) == ["a/2024-01-09/08.small.00000.json.snappy"]
    assert sorted(next(iter(got.values()))) == ["a-1", "a-2", "a-3", "a-4", "a-5"]
    parts = explode_parts(read_manifests(spark, config.manifest_root)).orderBy("part_no").collect()
    assert [p.location.rsplit("/", 1)[1] for p in parts] == listed
    in_order = []
    for p in parts:
        in_order += [json.loads(r.value)["uuid"] for r in spark.read.text(p.location).collect()]
    assert next(iter(got.values())) == in_order

    again = run_combine(spark, config, AT, announce=announced.append)
    assert again.placed.count() == again.log.count() == 0
    assert [rows(a.select(F.get_json_object("data", "$.eventType").alias("t"))) for a in announced] == [[("a",)], [("a",)]]

    write_spool(events(table, 6), config.staging_root)
    third = run_combine(spark, config, AT)
    assert third.placed.count() == third.log.count() == 1
    assert sorted(next(iter(combined(spark, config).values())))[-1] == "a-6"
    assert rows(group_headers(read_manifests(spark, config.manifest_root)), "version") == [(4,)]


def test_a_lost_target_is_rebuilt(spark, table, config):
    write_spool(events(table, 1, 2), config.staging_root)
    run_combine(spark, config, AT)
    (name,) = combined(spark, config)
    os.remove(os.path.join(config.target_root, name))
    healed = run_combine(spark, config, AT)
    assert (healed.placed.count(), healed.log.count()) == (0, 1)
    assert combined(spark, config)[name] == ["a-1", "a-2"] or sorted(combined(spark, config)[name]) == ["a-1", "a-2"]


def test_days_outside_the_window_stay_staged(spark, table, config):
    write_spool(events(table, 1, day=9), config.staging_root)
    write_spool(events(table, 2, day=12), config.staging_root)
    config.start_days_ago, config.end_days_ago = 2, -1
    run_combine(spark, config, AT)
    assert list(combined(spark, config)) == ["a/2024-01-09/08.small.00000.json.snappy"]
    config.no_date_limit = True
    run_combine(spark, config, AT)
    assert len(combined(spark, config)) == 2


def test_types_can_be_combined_one_by_one(spark, table, config):
    write_spool(events(table, 1, kind="a"), config.staging_root)
    write_spool(events(table, 1, kind="b"), config.staging_root)
    config.high_priority, config.low_priority = ["b"], ["a"]
    run_combine(spark, config, AT, types=["b"])
    assert list(combined(spark, config)) == ["b/2024-01-09/08.small.00000.json.snappy"]
    run_combine(spark, config, AT)
    assert len(combined(spark, config)) == 2


def test_any_type_can_name_a_folder(spark, table, config):
    kind = "x y%/z:1"
    write_spool(events(table, 1, 2, kind=kind), config.staging_root)
    announced = []
    run_combine(spark, config, AT, announce=announced.append)
    again = run_combine(spark, config, AT)
    assert (again.placed.count(), again.log.count()) == (0, 0)
    assert [sorted(v) for v in combined(spark, config).values()] == [[f"{kind}-1", f"{kind}-2"]]
    assert rows(announced[0].select(F.get_json_object("data", "$.eventType").alias("t"))) == [(kind,)]


def test_another_writer_waits(spark, table, config):
    write_spool(events(table, 1), config.staging_root)
    run_combine(spark, config, AT)
    write_spool(events(table, 2), config.staging_root)
    config.node = "other"
    assert run_combine(spark, config, AT + dt.timedelta(minutes=4)).placed.count() == 0
    assert run_combine(spark, config, AT + dt.timedelta(minutes=5)).placed.count() == 1


def test_a_failing_object_does_not_stop_the_others(spark, table, folder, tmp_path):
    (tmp_path / "a").write_bytes(b"x\n")
    sources = "array<struct<location: string, etag: string, size: bigint, last_modified: bigint>>"
    root = folder("combined")
    work = table(
        [
            (f"{root}/good", 4, [(str(tmp_path / "a"), "e", 2, 0)] * 2),
            (f"{root}/gone", 2, [(str(tmp_path / "none"), "e", 2, 0)]),
            (f"{root}/short", 9, [(str(tmp_path / "a"), "e", 9, 0)]),
        ],
        f"location string, size bigint, source_parts {sources}",
    )
    done = {r.location.rsplit("/", 1)[1]: r.status for r in compact(work).collect()}
    assert done == {"good": "combined", "gone": "failed", "short": "failed"}
    assert open(f"{root}/good").read() == "x\nx\n"
    with pytest.raises(PySparkException):
        compact(work, stop_on_error=True)


def test_objects_follow_the_codec_of_their_parts(spark, table, config):
    write_spool(events(table, 1, 2), config.staging_root, codec="gzip")
    write_spool(events(table, 3), config.staging_root, codec="gzip")
    write_spool(events(table, 4, kind="b"), config.staging_root, codec="none")
    assert rows(run_combine(spark, config, AT).log, "status") == [("combined",), ("combined",)]
    got = combined(spark, config)
    assert sorted(got) == ["a/2024-01-09/08.small.00000.json.gz", "b/2024-01-09/08.small.00000.json"]
    assert sorted(got["a/2024-01-09/08.small.00000.json.gz"]) == ["a-1", "a-2", "a-3"]
    # A file of another codec cannot be added; the object stays as it is, others go on.
    write_spool(events(table, 5), config.staging_root, codec="snappy")
    write_spool(events(table, 6, kind="b"), config.staging_root, codec="none")
    log = run_combine(spark, config, AT).log
    assert rows(log, "status", "message") == [("combined", None), ("failed", "several codecs: gz, snappy")]
    got = {k: sorted(v) for k, v in combined(spark, config).items()}
    assert list(got.values()) == [["a-1", "a-2", "a-3"], ["b-4", "b-6"]] or list(got.values()) == [["b-4", "b-6"], ["a-1", "a-2", "a-3"]]


def test_size_classes_are_not_mixed_in_a_rewrite(table, folder):
    root = folder("combined")
    parts = [("a.json", "e", 2, 0), ("b.json", "e", 5 * MB, 0)]
    work = table([(f"{root}/x.json", 2 + 5 * MB, parts)], "location string, size bigint, source_parts array<struct<location: string, etag: string, size: bigint, last_modified: bigint>>")
    assert rows(compact(work), "status", "message") == [("failed", "small and large files in one object")]


def later(seconds):
    return AT + dt.timedelta(seconds=seconds)


def test_types_are_due_when_new_and_after_their_delay(spark, table, config, folder):
    root = folder("schedule")
    run = lambda s, **more: rows(schedule.run_due(spark, config, root, later(s), delay=300, **more), "event_type", "status", "n_placed")
    write_spool(events(table, 1), config.staging_root)
    assert run(0) == [("a", "combined", 1)]
    write_spool(events(table, 2), config.staging_root)
    write_spool(events(table, 1, kind="b"), config.staging_root)
    assert run(100) == [("b", "combined", 1)]
    assert run(299) == []
    assert run(300, ended=lambda: later(350)) == [("a", "combined", 1)]
    # The delay begins at the end of a run.
    assert run(649) == [("b", "combined", 0)]
    assert run(650) == [("a", "combined", 0)]
    assert {k: sorted(v) for k, v in combined(spark, config).items()} == {
        "a/2024-01-09/08.small.00000.json.snappy": ["a-1", "a-2"],
        "b/2024-01-09/08.small.00000.json.snappy": ["b-1"],
    }
    assert len(os.listdir(f"{root}/type=a")) == 4  # the last run and the one before


def test_two_schedulers_share_the_types(spark, table, config, folder):
    root = folder("schedule")
    write_spool(events(table, 1), config.staging_root)
    ours = schedule.claim_due(config, root, 0)
    assert ours == {"a": 1}
    # While one combines its type, the other takes what is left, in a pass of its own.
    write_spool(events(table, 1, kind="b"), config.staging_root)
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(schedule._combine, spark, config, AT, sorted(ours), None)
        second = pool.submit(lambda: rows(schedule.run_due(spark, config, root, AT, lease=10**10), "event_type", "n_written"))
        assert (first.result()[0][:4], second.result()) == (("a", "combined", 1, 1), [("b", 1)])
    assert rows(read_manifests(spark, config.manifest_root), "event_type") == [("a",), ("b",)]
    # The first never said that it ended: its claim counts until the lease is over.
    assert schedule.claim_due(config, root, 3600, delay=10**10, lease=3601) == {}
    assert schedule.claim_due(config, root, 3601, delay=10**10, lease=3601) == {"a": 2}


def test_of_many_schedulers_one_has_each_type(config, folder):
    root = folder("schedule")
    for kind in "abc":
        os.makedirs(f"{config.staging_root}/event_type={kind}")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: schedule.claim_due(config, root, 0), range(8)))
    assert sorted(k for g in got for k in g) == ["a", "b", "c"]


def test_a_failing_type_stops_no_other(spark, table, config, folder, monkeypatch):
    write_spool(events(table, 1), config.staging_root)
    write_spool(events(table, 1, kind="b"), config.staging_root)

    def breaking(spark, config, as_of, types, announce):
        if "a" in types:
            raise RuntimeError("no")
        return run_combine(spark, config, as_of, types, announce)

    monkeypatch.setattr(schedule, "run_combine", breaking)
    root = folder("schedule")
    got = rows(schedule.run_due(spark, config, root, AT), "event_type", "status", "n_placed", "message")
    assert got == [("a", "failed", 0, "RuntimeError: no"), ("b", "combined", 1, None)]
    assert rows(schedule.run_due(spark, config, root, later(299)), "event_type") == []
    assert rows(schedule.run_due(spark, config, root, later(300)), "event_type", "status") == [("a", "failed"), ("b", "combined")]


def test_completion_events_are_ordinary_events(table):
    types = table([("a",), ("a",), ("b",)], "event_type string")
    out = ops.combine_completed(types, "g", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert out.columns == ["type", "uuid", "host", "timestamp", "data"]
    assert rows(out, "type", "data") == [
        ("CombineCompleted", '{"groupId":"g","eventType":"a"}'),
        ("CombineCompleted", '{"groupId":"g","eventType":"b"}'),
    ]


def claims(table, root, name, at, *groups, version=1):
    proposed = table([("a", "2024-01-01", f"{g:02d}", "small", version) for g in groups], "event_type string, date string, hour string, size_class string, read_version bigint")
    return {r[0]: r[1] for r in rows(claim_groups(proposed, root, name, at, lease_ms=1000), "hour", "status")}


def test_a_version_is_replaced_once(spark, table, folder):
    root = folder("manifest")
    write_manifest(manifest(table, [("a", 1)]), root, 1)
    assert claims(table, root, "x", 100, 0, 1) == {"00": "commit", "01": "commit"}
    assert claims(table, root, "x", 100, 0, 1) == {"00": "commit", "01": "commit"}  # a repeated task
    assert claims(table, root, "y", 200, 1, 2) == {"01": "conflict", "02": "commit"}
    assert claims(table, root, "y", 200, 1, version=2) == {"01": "commit"}
    write_manifest(manifest(table, [("a", 1)], version=2), root, "x")
    assert claims(table, root, "z", 10_000, 0, 1, 2) == {"00": "conflict", "01": "conflict", "02": "commit"}  # x is there, y died
    assert claims(table, root, "w", 10_100, 2) == {"02": "conflict"}


def test_of_many_at_once_one_creates(folder):
    path = f"{folder('claims')}/a/b"
    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda i: create_exclusive(path, str(i).encode()), range(64)))
    assert sum(made) == 1 and read_small(path) == str(made.index(True)).encode()
    assert os.listdir(os.path.dirname(path)) == ["b"]


def test_unfinished_passes_are_not_read(spark, table, folder):
    root = folder("manifest")
    write_manifest(manifest(table, [("a", 1)]), root, 1)
    os.remove(f"{write_manifest(manifest(table, [('a', 1)], version=5), root, 'dead')}/_SUCCESS")
    assert rows(read_manifests(spark, root), "version") == [(1,)]


def test_a_snapshot_stands_for_its_passes(spark, table, folder):
    root = folder("manifest")
    for n in range(1, 7):
        write_manifest(manifest(table, [("a", 1)] * n, version=n), root, n)
        if n % 2 == 0:
            write_snapshot(spark, root, f"{n:012d}", keep=2)
    view = manifest_view(spark, root)
    assert (view.snapshot, len(view.folded), view.tail) == ("snapshot=000000000006-000000000006", 6, [])
    assert sorted(n for n in os.listdir(root) if n.startswith("snapshot=")) == [f"snapshot={n:012d}-{n:012d}" for n in (4, 6)]
    opened = {f.removeprefix("file:").removeprefix("//").removeprefix(root).split("/")[1] for f in read_manifests(spark, root).inputFiles()}
    assert opened == {"snapshot=000000000006-000000000006"}
    # A pass of an older name that ends after the snapshot, and one that never ends.
    write_manifest(manifest(table, [("a", 1)], [("b", 1)], version=7), root, "000000000000")
    os.remove(f"{write_manifest(manifest(table, [('a', 1)], version=9), root, 8)}/_SUCCESS")
    assert [os.path.basename(p) for p in manifest_view(spark, root).tail] == ["pass=000000000000"]
    assert rows(read_manifests(spark, root), "ordinal", "version") == [(0, 7), (1, 7)]
    assert rows(read_headers(spark, root), "version", "n_objects") == [(7, 2)]


def test_an_unfinished_snapshot_is_not_read(spark, table, folder):
    root = folder("manifest")
    write_manifest(manifest(table, [("a", 1)]), root, 1)
    os.remove(f"{write_snapshot(spark, root, '1')}/_SUCCESS")
    write_manifest(manifest(table, [("a", 1)], version=2), root, 2)
    view = manifest_view(spark, root)
    assert (view.snapshot, len(view.tail)) == (None, 2)
    assert rows(read_manifests(spark, root), "version") == [(2,)]


def test_of_equal_versions_the_later_pass_counts(spark, table, folder):
    root = folder("manifest")
    write_manifest(manifest(table, [("a", 1)], creator="x"), root, 2)
    write_snapshot(spark, root, "2")
    write_manifest(manifest(table, [("a", 1)], creator="y"), root, 1)
    assert rows(read_manifests(spark, root), "creator") == rows(read_headers(spark, root), "creator") == [("x",)]


def test_passes_are_folded_as_they_pile_up(spark, table, config):
    config.snapshot_every = 2
    for i in range(4):
        write_spool(events(table, i), config.staging_root)
        run_combine(spark, config, AT, types=["a"])
    assert manifest_view(spark, config.manifest_root).snapshot is not None
    assert len(manifest_view(spark, config.manifest_root).tail) < 2
    assert sorted(next(iter(combined(spark, config).values()))) == ["a-0", "a-1", "a-2", "a-3"]
    assert run_combine(spark, config, AT, types=["b"]).log.count() == 0
