"""A training-data pipeline: five stages over `documents`, each reading what the one before it wrote.

All stages but the last keep the columns of `documents`. Language identification removes documents that are far from every language or
have no letter; of each group of near-duplicates one document stays; documents that hold a benchmark item go; secrets that are not
shown to be examples are masked in the text; the mix takes documents by source weights and adds its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosswind.llm import decontam, langid, mixing, secrets, simhash
from crosswind.llm.common import table
from crosswind.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_owned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

# Centroids and fingerprints are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
