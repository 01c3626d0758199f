import gzip
import io

import pytest
from pyspark.sql import functions as F

from eventweir.llm import warc
from eventweir.operators import joins
from eventweir.session import scratch_path

PAGES = [
    (3, "http://a/3", "<p>same</p>"),
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/\r\n2", "é\r\n\r\nWARC/1.1\r\n\r\n漢"),
    (4, None, None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "x" * 2_000_000),
    (1, "http://a/1", "<p>same</p>"),
    (None, "http://a/none", "<p>same</p>"),
]


def archived(spark, table, min_bytes):
    pages = warc.with_digest(table(PAGES, "page_id bigint, url string, html string"))
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(pages, min_bytes), path)
    return path, warc.follow_revisits(warc.read_archives(spark, path)).collect()


@pytest.mark.parametrize("max_bytes", [joins.BROADCAST_BYTES, 0])
def test_equal_payloads_become_revisits(spark, table, monkeypatch, max_bytes):
    monkeypatch.setattr(joins.join_small, "__defaults__", ("inner", max_bytes, 3))
    path, rows = archived(spark, table, 0)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    want = [(1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None)]
    want += [(5, "revisit", 4), (6, "response", None), (None, "revisit", 1)]
    assert got == sorted(want, key=str)
    for r in rows:
        html = next(p[2] for p in PAGES if p[0] == r["page_id"]) or ""
        assert r["payload_digest"] == warc.file_digest(html) and r["payload_bytes"] == len(html.encode())
    stored = warc.read_archives(spark, path).collect()
    ids = {(r["page_id"], r["payload_digest"]): r["record_id"] for r in stored}
    refers = {r["page_id"]: r["refers_to"] for r in rows}
    for r in stored:
        html = next(p[2] for p in PAGES if p[0] == r["page_id"]) or ""
        assert r["payload"] == (html if r["record_type"] == "response" else "")
        first = refers[r["page_id"]]
        assert r["refers_to_id"] == (ids[first, r["payload_digest"]] if first is not None else None)


def test_small_payloads_stay_responses(spark, table):
    _, rows = archived(spark, table, 1)
    assert {r["page_id"]: r["record_type"] for r in rows}[5] == "response"


def test_archives_are_plain_records(spark, table):
    path, _ = archived(spark, table, 0)
    contents = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    seen = 0
    for content in contents:
        data = io.BytesIO(gzip.decompress(content))
        while line := data.readline():
            assert line == b"WARC/1.1\r\n"
            headers = {}
            while (line := data.readline()) != b"\r\n":
                name, value = line.decode().rstrip("\r\n").split(": ", 1)
                headers[name] = value
            data.read(int(headers["Content-Length"]))
            assert data.read(4) == b"\r\n\r\n"
            seen += 1
    assert seen == len(PAGES)


def test_no_pages(spark, table):
    pages = table([], "page_id bigint, url string, html string")
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(warc.with_digest(pages)), path)
    assert warc.follow_revisits(warc.read_archives(spark, path)).collect() == []


def test_clashing_names(spark, table):
    made = "first_id string, n int, payload string, record_type int, refers_to string, payload_digest int, record_id int, _salt int"
    pages = table([(*p, "f", 1, "p", 2, "r", 3, 4, 5) for p in PAGES], f"page_id bigint, url string, html string, {made}")
    found = warc.resolve_revisits(warc.with_digest(pages))
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["first_id"], r["n"]) for r in found.collect()}
    assert {(3, "revisit", 1, "f", 1), (1, "response", None, "f", 1)} <= got


def test_a_page_id_with_two_payloads(spark, table):
    pages = warc.with_digest(table([(1, None, "a"), (1, None, "b"), (2, None, "a"), (3, None, "b")], "page_id bigint, url string, html string"))
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(pages), path)
    rows = warc.follow_revisits(warc.read_archives(spark, path)).collect()
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    a, b = warc.file_digest("a"), warc.file_digest("b")
    want = [(1, a, "response", None, 1), (1, b, "response", None, 1), (2, a, "revisit", 1, 1), (3, b, "revisit", 1, 1)]
    assert got == sorted(want, key=str)


def test_a_changed_payload_is_an_error(spark, table):
    pages = warc.with_digest(table([(1, None, "abc")], "page_id bigint, url string, html string"))
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(pages).withColumn("html", F.lit("abd")), path)
    with pytest.raises(Exception, match="payload is not what its digest says"):
        warc.follow_revisits(warc.read_archives(spark, path)).collect()


def test_members_and_pieces():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    packed = gzip.compress(record) + gzip.compress(record * 2)
    import pyarrow as pa

    found = list(warc._records(warc._inflated(pa.py_buffer(packed), block=7)))
    assert [f["payload"] for f in found] == ["hello"] * 3
