"""WARC archives: write, read, and resolve equal payloads to revisits.

Archives are gzip files of WARC 1.1 records, a record being a header block, a
blank line, the payload in UTF-8 and two line ends.  They are written by
Spark's text writer, which puts the two line ends behind each record, and read
by length from Spark's binary files, so both work wherever Spark does.

Only headers are shuffled by payload digest to find, per digest, the record
with the smallest id; that is combined in the tasks, so a payload that a third
of all pages share is no problem.  The originals of repeated payloads are
stored and measured: if small they go to the pages, which then do not move at
all; else pages meet them by digest, each digest spread over many tasks.  The
others become ``revisit`` records: fresh headers that refer to the original,
and no payload.

Reading believes no header about a payload: sizes and digests are those of the
bytes that were read, a response whose digest differs from the stated one is an
error, and a revisit gets size and page of the response it refers to.

Nulls: a null payload is an empty one; a null url has no target header; a page
without an id takes no part as an original unless all of its copies lack one,
and then all of them are responses.  Pages that repeat the smallest id are
responses too.  Line ends in a url are percent-encoded.  Other columns of the
pages, whatever their names, are not written; ``record_type``, ``refers_to``
and ``payload_digest`` are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.llm.text import column
from eventweir.operators.joins import join_small, small_table
from eventweir.session import written_table

END = "\r\n"
#: A name that no column of a table of pages has.
FIRST = "_warc_first_id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id bigint, record_id string, record_type string, target_uri string, payload_digest string,"
    " refers_to_id string, payload string"
)
#: Digits of base 32 as ``conv`` writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a payload in UTF-8; five hex digits are four of base 32."""
    hexes = F.sha1(F.coalesce(payload, F.lit("")).cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexes, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def with_digest(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Add ``payload_digest`` and ``payload_bytes`` of the payload in UTF-8."""
    size = F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("bigint")
    return pages.withColumns({"payload_digest": digest(F.col(payload)), "payload_bytes": size})


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to rows with ``page_id, payload_digest, payload_bytes``.

    Of the records with equal payloads of at least ``min_bytes`` that with the
    smallest ``page_id`` is the response.  No other columns than these three are
    shuffled to find it."""
    headers = records.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    same = headers.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias(FIRST), F.count("*").alias("n"))
    originals = small_table(same.where("n > 1").drop("n"), "originals")
    both = join_small(records, originals, ["payload_digest", "payload_bytes"], ["page_id"], "left")
    is_revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col(FIRST)) & F.col(FIRST).isNotNull(), F.lit(False))
    both = both.withColumn("record_type", F.when(is_revisit, "revisit").otherwise("response"))
    return both.withColumn("refers_to", F.when(is_revisit, F.col(FIRST))).drop(FIRST)


def record_id(page_id: Column, payload_digest: Column) -> Column:
    """A stable URN from the page's id and payload."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), payload_digest))
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", payload: str = "html", url: str = "url") -> None:
    """Write one record per row of resolved pages; revisits go without payload."""
    body = F.when(F.col("record_type") == "response", F.coalesce(F.col(payload), F.lit(""))).otherwise("")
    target = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))

    lines = [
        F.lit("WARC/1.1"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.col("payload_digest")))),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        header("X-Page-Id", F.col("page_id")),
        header("Content-Length", F.octet_length(body)),
    ]
    record = F.concat(F.concat_ws(END, *lines), F.lit(END + END), body)
    records.select(record.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path`` as they are stated, with the columns of ``RECORD``."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if n == "page_id" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                rows, size = [], 0
                for record in _records(_inflated(content.as_buffer())):
                    rows.append(record)
                    size += len(record["payload"]) + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def follow_revisits(records: DataFrame) -> DataFrame:
    """Size, digest and original of every record of ``read_archives``, without payloads:
    ``page_id, record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to``.

    Payloads are measured and digested; only these headers are stored and
    joined.  A revisit whose original is not among the records has no size."""
    stated = F.col("payload_digest")
    broken = (F.col("record_type") == "response") & ~stated.eqNullSafe(digest(F.col("payload")))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("record_id")))).otherwise(stated)
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("bigint"))
    own = ["page_id", "record_id", "record_type", "target_uri"]
    headers = written_table(records.select(*own, "refers_to_id", checked.alias("payload_digest"), size.alias("payload_bytes")), "warc-headers")
    is_revisit = F.col("record_type") == "revisit"
    revisits = headers.where(is_revisit).drop("payload_bytes")
    sought = revisits.select(F.col("refers_to_id").alias("record_id"), "payload_digest").distinct()
    found = headers.where(~is_revisit).join(sought, ["record_id", "payload_digest"], "left_semi")
    found = found.groupBy(F.col("record_id").alias("refers_to_id"), "payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes")
    )
    found = small_table(found, "warc-originals")
    followed = join_small(revisits, found, ["refers_to_id", "payload_digest"], ["page_id", "record_id"], "left")
    responses = headers.where(~is_revisit).withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = [*own, "payload_digest", "payload_bytes", "refers_to"]
    return responses.select(*columns).unionByName(followed.select(*columns))


def _inflated(data: pa.Buffer, block: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece."""
    unzip, view = zlib.decompressobj(31), memoryview(data)
    for at in range(0, len(view), block):
        piece = bytes(view[at : at + block])
        while piece:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            yield unzip.decompress(piece)
            piece = unzip.unused_data


def _records(pieces: Iterator[bytes]) -> Iterator[dict]:
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        at = 0
        while (head_end := buffer.find(b"\r\n\r\n", at)) >= 0:
            headers = dict(
                line.split(": ", 1) for line in buffer[at:head_end].decode().split(END) if ": " in line
            )
            start, length = head_end + 4, int(headers["Content-Length"])
            if len(buffer) < start + length + 4:
                break
            yield _record(headers, buffer[start : start + length].decode())
            at = start + length + 4
        del buffer[:at]
    if buffer.strip():
        raise ValueError("an archive ends within a record")


def _record(headers: dict[str, str], payload: str) -> dict:
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "page_id": number("X-Page-Id"),
        "record_id": headers.get("WARC-Record-ID"),
        "record_type": headers.get("WARC-Type"),
        "target_uri": headers.get("WARC-Target-URI"),
        "payload_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
        "refers_to_id": headers.get("WARC-Refers-To"),
        "payload": payload,
    }


def file_digest(payload: str) -> str:
    """The digest of a payload, as ``with_digest`` has it."""
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
