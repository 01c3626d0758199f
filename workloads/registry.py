"""Registration of queries and their SQL twins."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventweir.session import use_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = {"events", "orders", "lineitem", "supplier", "pages", "conversations"}


def query(name: str, sql: str | None = None):
    """Register ``function(tables)`` under ``name``; ``sql`` runs on the same tables."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


class Tables:
    """The given tables of one scale, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_settings(spark)
        self.sf_dir = sf_dir
        self.known: set[str] = set()

    def sql(self, text: str) -> DataFrame:
        for name in re.findall(r"\w+", text):
            if name not in TABLES or name in self.known:
                continue
            self.known.add(name)
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            self.spark.read.parquet(path).createOrReplaceTempView(name)
        return self.spark.sql(text)
