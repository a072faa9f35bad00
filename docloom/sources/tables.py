"""Access to the Parquet tables a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``; any path Spark can read will do."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
