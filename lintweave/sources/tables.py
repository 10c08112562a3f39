"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, each: int = 4) -> DataFrame:
    """Rows of a small file dealt to several tasks for each core, before expressions make large texts of them."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism)
