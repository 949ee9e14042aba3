"""The Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.session import ship


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; columns are pruned and filters pushed by the plan that uses it."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
