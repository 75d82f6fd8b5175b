"""Readers: tables of a data folder, HTML pages as node rows, JSON corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
