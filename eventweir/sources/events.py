"""Reading events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.envelope import one_json_value
from eventweir.schema import ENVELOPE_TEXT


def with_instant(df: DataFrame) -> DataFrame:
    """Turn the timestamp text into an instant.  Text that is no timestamp
    becomes NULL; ``timestamp_text`` keeps it, so it can be told from a missing one."""
    return df.withColumn("timestamp_text", F.col("timestamp")).withColumn(
        "timestamp", F.expr("try_cast(timestamp AS timestamp)")
    )


def read_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Events from files that each hold one JSON array; the file is the batch."""
    rows = spark.read.schema(ENVELOPE_TEXT).option("multiLine", True).json(path)
    return with_instant(rows.withColumn("batch_id", F.col("_metadata.file_path")))


def explode_batches(df: DataFrame, body: str = "body") -> DataFrame:
    """Events from a column of JSON arrays, with their ``seq`` in the batch.
    The other columns stay; a batch without events has no rows.  Turn away what
    ``unreadable_batches`` finds first."""
    events = F.from_json(body, f"array<struct<{', '.join(_ddl_fields())}>>")
    others = [c for c in df.columns if c != body]
    return with_instant(df.select(*others, F.posexplode(events).alias("seq", "e")).select(*others, "seq", "e.*"))


def unreadable_batches(df: DataFrame, body: str = "body") -> DataFrame:
    """Batches ``explode_batches`` cannot read: their body is not a JSON array."""
    return df.where(~_is_array(F.col(body)))


def _ddl_fields() -> list[str]:
    return [field.strip().replace(" ", ": ", 1) for field in ENVELOPE_TEXT.split(",")]


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events from newline-delimited, possibly compressed files below ``path``,
    with the ``file`` they come from.  Lines that do not parse are kept in ``corrupt_line``."""
    reader = spark.read.schema(f"{ENVELOPE_TEXT}, corrupt_line string")
    options = {"recursiveFileLookup": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_line"}
    return with_instant(reader.options(**options).json(path).withColumn("file", F.col("_metadata.file_path")))


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events arriving as files below ``path``; see ``events_of_files``."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return events_of_files(reader.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path")))


def stream_event_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events arriving as files too large to be taken whole, an event or an
    array of events on every line.  Lines that do not parse are in ``corrupt_body``."""
    reader = spark.readStream.schema(f"{ENVELOPE_TEXT}, corrupt_body string").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_instant(reader.option("columnNameOfCorruptRecord", "corrupt_body").json(path))


def events_of_files(df: DataFrame) -> DataFrame:
    """Events of whole files (``file, value``) with ``batch_id`` and ``seq``.

    A file is one JSON array, over as many lines as it likes, or has an array or
    a single event on every line; each array is a batch.  What cannot be read
    becomes one row with its text in ``corrupt_body``, so nothing is lost."""
    whole = _is_array(F.col("value"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.btrim(line) != "")
    bodies = F.when(whole, F.array("value")).otherwise(lines)
    rows = df.select("file", F.posexplode(bodies).alias("_line", "_body"))
    single = F.col("_body").startswith("{") & one_json_value(F.col("_body"))
    rows = rows.withColumn("_body", F.when(single, F.concat(F.lit("["), "_body", F.lit("]"))).otherwise(F.col("_body")))
    rows = rows.withColumn("corrupt_body", F.when(~_is_array(F.col("_body")), F.col("_body")))
    rows = rows.withColumn("_body", F.when(F.col("corrupt_body").isNull(), F.col("_body")).otherwise("[null]"))
    rows = rows.select(F.concat_ws("#", "file", "_line").alias("batch_id"), "corrupt_body", "_body")
    return explode_batches(rows, "_body")


def _is_array(body: Column) -> Column:
    """True when the text is exactly one JSON array."""
    return F.coalesce(F.json_array_length(body).isNotNull() & one_json_value(body), F.lit(False))


def to_envelope(
    df: DataFrame, event_type: str | Column, timestamp: Column, uuid: Column, host: Column, data_columns: list[str]
) -> DataFrame:
    """Wrap rows of an application table as events; ``data_columns`` become the payload."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    return df.select(
        kind.alias("type"),
        uuid.cast("string").alias("uuid"),
        host.cast("string").alias("host"),
        timestamp.cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(*data_columns)).alias("data"),
    )
