"""From documents to packed sequences: five stages, each written and read again before the next.

Every stage but the last returns the columns of documents. Quality rules drop what they reject; exact dedup keeps the row
of the largest id of each text; near-dedup keeps the document of the least id of each component; the secret scan replaces
each finding by a mark; packing returns a row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nodeweave.llm import exact_dedup, near_dedup, packing, quality_rules, secret_scan
from nodeweave.llm.common import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.vocabulary_path())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", pack)]

#: Near-dedup's components and the tokenizer aren't expressible in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
