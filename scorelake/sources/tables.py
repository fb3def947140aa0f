"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet`` (one file or a folder of part files)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
