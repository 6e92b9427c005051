"""Reading of the tables that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table of that name in a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
