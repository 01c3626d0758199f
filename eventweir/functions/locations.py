"""Names and parts of object locations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: files below this size cannot be copied part by part.
SMALL_BELOW = 5 * 1024 * 1024

DEFAULT_TARGET = 512 * 1024 * 1024


def location_parts(location: Column) -> dict[str, Column]:
    """``bucket``, ``key``, ``dir`` (with its last slash) and ``name`` of
    ``scheme://bucket/key`` or of a plain path, which has no bucket.

    The name is the last path segment, with or without a trailing slash; NULL at the root.
    """
    path = F.regexp_extract(location, r"^(?:[A-Za-z0-9+.-]+://[^/]*|[a-z]+:)?(/.*)?$", 1)
    trimmed = F.regexp_replace(path, "/$", "")
    return {
        "bucket": F.regexp_extract(location, r"^[^:]+://([^/]*)", 1),
        "key": F.regexp_replace(path, "^/", ""),
        "dir": F.regexp_extract(location, r"^(.*/)[^/]*$", 1),
        "name": F.nullif(F.substring_index(trimmed, "/", -1), F.lit("")),
    }


def combined_prefix(target: str, size_class: Column) -> Column:
    """``target/type/date/hour.size``, the common start of a group's combined objects."""
    if target.endswith("."):
        raise ValueError(f"base ends with dot: {target}")
    bucket = F.concat_ws("/", F.lit(target.rstrip("/")), "event_type", "date", "hour")
    return F.concat(bucket, F.lit("."), size_class)


def combined_location(prefix: Column, ordinal: Column, suffix: str | Column = "json.snappy") -> Column:
    """``prefix.00007.json.snappy`` for the object with ordinal 7.

    The suffix follows the codec the parts were written with, see ``suffix_of``."""
    if isinstance(suffix, str):
        if suffix.startswith("."):
            raise ValueError(f"suffix starts with dot: {suffix}")
        suffix = F.lit(suffix)
    return F.concat(prefix, F.format_string(".%05d.", ordinal), suffix)


def location_codec(location: Column) -> Column:
    """The codec a file's name ends with, empty for none."""
    return F.regexp_extract(location, r"\.(snappy|gz|zst|zstd|bz2|lz4|deflate)$", 1)


def suffix_of(location: Column) -> Column:
    """Suffix of an object that joins files like this one."""
    codec = location_codec(location)
    return F.when(codec == "", F.lit("json")).otherwise(F.concat(F.lit("json."), codec))


def size_class(size: Column) -> Column:
    """``small`` below 5 MiB, else ``large``; NULL for empty files, which are never combined."""
    return F.when(size == 0, None).when(size < SMALL_BELOW, "small").otherwise("large")


def priority_class(event_type: Column, high: Iterable[str], low: Iterable[str]) -> Column:
    """``high``, ``low`` or ``normal``; a type may not be on both lists."""
    high, low = set(high), set(low)
    if high & low:
        raise ValueError(f"types with both priorities: {sorted(high & low)}")
    return (
        F.when(event_type.isin(sorted(high)), "high")
        .when(event_type.isin(sorted(low)), "low")
        .otherwise("normal")
    )
