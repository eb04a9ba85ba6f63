"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; the scan reads only the columns and row groups that the query needs."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
