"""Intermediate Parquet tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lintweave-work-")


class Work:
    """A folder of tables that cut lineages and outlive executors; a table may get further parts."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lintweave-{name}-{uuid.uuid4().hex}"
        self.made = 0

    def name(self) -> str:
        self.made += 1
        return f"t{self.made}"

    def put(self, df: DataFrame, name: str | None = None, part: int = 0) -> DataFrame:
        """Writes df as a part of a table and returns that part as read back."""
        path = f"{self.root}/{name or self.name()}/part{part}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, like: DataFrame, name: str, parts: int) -> DataFrame:
        """The first parts of a table, with like's columns."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{name}/part{i}" for i in range(parts)))

    def drop(self, name: str | None = None) -> None:
        """Deletes a table, or the folder, when nothing will read it again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
