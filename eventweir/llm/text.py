"""Small helpers the text operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.session import use_settings

#: White space of the line and shingle contracts, as characters.
BLANKS = " \t\n\x0b\f\r"


def session(spark: SparkSession) -> SparkSession:
    """Settings for tables of long texts: Arrow batches of few rows and bytes."""
    use_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")
    return spark


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_chunks(batch: pa.RecordBatch, name: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``max_bytes`` together; at least one row each."""
    first, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column(batch, name)).fill_null(0).to_pylist()):
        if size and size + n > max_bytes:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if batch.num_rows > first:
        yield batch.slice(first)


def fields(df: DataFrame, *names: str) -> str:
    """DDL of some columns of ``df``."""
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)
