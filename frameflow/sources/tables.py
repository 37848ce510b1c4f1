"""The driver's parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameflow.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
