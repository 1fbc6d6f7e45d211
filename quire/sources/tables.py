"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table `name` of a directory that holds one Parquet file or folder for each table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
