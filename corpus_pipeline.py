"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage gets what its predecessor kept (written as Parquet and read again) and
its decisions take effect: toxic documents go, repeated lines go, one document of
each near-duplicate class stays, benchmark passages go from contaminated
documents, and what is left is packed.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from penmark.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from penmark.llm.common import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("packing", pack),
]

# trained trees, Bloom filters and retrieval order can't be said in SQL; tests/llm compares the
# stages with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
