"""Where queries and their SQL are kept, and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, d: str) -> DataFrame:
    """Points (id, pos): the key and the balance."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey").cast("double"), F.col("c_acctbal")).alias("pos"))
