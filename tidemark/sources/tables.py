"""Readers of the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, a single parquet file or a folder of them; the scan stays lazy, so filters and columns reach it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
