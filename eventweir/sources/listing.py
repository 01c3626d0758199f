"""Listing staged and combined files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.locations import location_parts
from eventweir.functions.transfer import list_folder, subfolders
from eventweir.schema import BUCKET

_ENTRY = "location string, is_folder boolean, size bigint, last_modified bigint, etag string"


def list_objects(
    spark: SparkSession,
    root: str,
    days: list[str] | None = None,
    etag: str = "version",
    recursive: bool = True,
    types: list[str] | None = None,
) -> DataFrame:
    """Files below ``root`` (or only directly in it): ``location, size, etag,
    last_modified`` (epoch ms) and the parts of the location.  Empty files are
    listed, names that start with an underscore or a dot are not.

    Tasks do the listing, a folder each: types, then their days, then all below
    a day, so no machine holds all names.  ``days`` keeps to day folders
    (second level, ``day`` or ``date=day``) of these names; the others are not
    opened.  ``types`` keeps to type folders (first level) the same way.  The etag is made of size and time; ``etag="md5"`` reads every file.
    """
    content = etag == "md5"

    def entries(deep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = [c.split()[0] for c in _ENTRY.split(", ")]
            for pdf in batches:
                for folder in pdf["location"]:
                    yield pd.DataFrame(list_folder(folder, deep, content), columns=columns)

        return run

    def below(folders: DataFrame, deep: bool) -> DataFrame:
        tasks = max(spark.sparkContext.defaultParallelism, 1)
        spread = folders.where("is_folder").select("location").repartition(tasks, "location")
        return spread.mapInPandas(entries(deep), _ENTRY)

    start = spark.createDataFrame([(root.rstrip("/") or "/",)], "location string")
    top = start.mapInPandas(entries(False), _ENTRY)
    if types is not None:
        kind = F.regexp_replace(F.substring_index("location", "/", -1), "^event_type=", "")
        top = top.where(~F.col("is_folder") | kind.isin(types))
    found = top
    if recursive:
        second = below(top, False)
        if days is not None:
            name = F.regexp_replace(F.substring_index("location", "/", -1), "^date=", "")
            second = second.where(F.col("is_folder") & name.isin(days))
            found = below(second, True)
        else:
            found = top.unionByName(second).unionByName(below(second, True))
    files = found.where("NOT is_folder").select("location", "size", "etag", "last_modified")
    return with_location_parts(files)


def with_location_parts(listing: DataFrame) -> DataFrame:
    return listing.withColumns(location_parts(F.col("location")))


def with_bucket(listing: DataFrame) -> DataFrame:
    """Read ``event_type``, ``date`` and ``hour`` off locations: ``column=value``
    folders anywhere, else plain ``type/date/hour/name`` at the end.  Values are
    folder names as they are, so that they can name folders again."""
    plain = F.split("location", "/")

    def segment(column: str, from_end: int) -> Column:
        named = F.regexp_extract("location", f"/{column}=([^/]*)/", 1)
        return F.when(named != "", named).otherwise(F.try_element_at(plain, F.lit(-from_end)))

    return listing.withColumns({"event_type": segment("event_type", 4), "date": segment("date", 3), "hour": segment("hour", 2)})


def list_partitions(listing: DataFrame, level: str = "hour") -> DataFrame:
    """Distinct event types, or buckets down to ``date`` or ``hour``."""
    return listing.select(*BUCKET[: BUCKET.index(level) + 1]).distinct()


def event_types(root: str) -> list[str]:
    """Types below a staging root, as their folders are named."""
    return [name.removeprefix("event_type=") for name in subfolders(root) if not name.startswith(("_", "."))]
