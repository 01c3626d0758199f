"""A training corpus from raw documents.

Each stage is a function of ``(spark, docs, sf_dir)``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; other columns of the table go in the first stage.

Documents with null or empty texts are not toxic, have no near copies and no
leaks, so they stay.  Documents without an id stay too, as they can't be named
as copies.  Repeated rows are copies of each other: those that share the
smallest id of their component all stay.  Empty tables pass through; without
labels or benchmark items the stages that need them keep everything.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from eventweir.llm.text import session
from eventweir.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def clean_tone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects."""
    spark = session(spark)
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(toxicity.likelihood(F.col("text"), model) < toxicity.THRESHOLD)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that ten or more documents hold; documents stay, if empty."""
    session(spark)
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return kept.withColumn("n_chars", n_chars.cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component."""
    session(spark)
    return ngram_join.keep_one(docs.select(*COLUMNS), ngram_join.Join(k=5, similarity=80))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    spark = session(spark)
    found = decontaminate.contamination(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), size=10)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text they decode to."""
    session(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", clean_tone),
    ("line_dedup", repeated_lines),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: A model decides the first stage, so SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    spark = session(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
