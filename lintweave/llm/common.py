"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters that one slice of an Arrow batch may hold while Python works on it.
SLICE_ROWS = 256
SLICE_CHARS = 1 << 20
#: Bytes of an Arrow batch while a table of a Shelf is written; JVM and Python each hold some of them for each task.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty text; other columns can't clash with results."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts an Arrow batch where SLICE_ROWS or SLICE_CHARS is reached, so that memory follows the longest text."""
    texts = batch.column(batch.schema.get_field_index(text))
    start = chars = 0
    n = len(texts)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i in range(n):
        chars += lengths[i]
        if i + 1 - start >= SLICE_ROWS or chars >= SLICE_CHARS or i + 1 == n:
            part = batch.slice(start, i + 1 - start)
            yield part, [x or "" for x in part.column(batch.schema.get_field_index(text)).to_pylist()]
            start, chars = i + 1, 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lintweave-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


class Shelf:
    """Intermediate Parquet tables in the shared folder; written once, they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lintweave-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes df and returns it as read back, with its own schema."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        before = self.spark.conf.get(_BATCH[0])
        self.spark.conf.set(*_BATCH)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=partition_by)
        finally:
            self.spark.conf.set(_BATCH[0], before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def tidy(self) -> None:
        """Shuffles of finished tables go from the disks; they do when the driver's JVM collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which a result still reads."""
        for name in self.names - set(names):
            self.drop(name)
