"""Operator 11: lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. Each document becomes its distinct
keys of at least MIN_CHARS code points, as 128-bit hashes. Documents come in batches; a batch's keys are counted, with the
largest id that holds each, and merge-anti-joined with the runs: a key that a run already knows in enough documents and
with an id at least as large says nothing new and goes. The rest becomes a run of its own. A level of FANOUT runs is
compacted to one run of the next level. Runs are tables bucketed and sorted by hash, so that the anti-joins shuffle the
batch alone, once, and never a run; only a compaction, which writes its runs anew, deals them again.

At the end the runs are one relation of shared keys. It is joined with the documents' keys, in a form that adaptive
execution can split, and the lines to drop come back to their document. Documents are told apart by id: rows that repeat an
id are one document for counting, each of them gets its own result. A null id is an id, smaller than all others. Null and
empty texts have one empty line. A text all of whose lines go is empty. Two keys are taken as one if their 128-bit hashes
agree. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, documents, id_text, slices

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
#: Runs of a level that are compacted to one of the next.
FANOUT = 3
HASH = ["h1", "h2"]


def line_hash(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """A line's key as 16 bytes; None if it is shorter than least code points."""
    key = line.strip().lower()  # of bytes: ASCII whitespace, A-Z
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, batches: int = BATCHES, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, mark, h1, h2, batch) of docs (doc_id, text): each row's distinct keys; mark tells texts of an id apart."""

    def run(parts):
        for batch in parts:
            for part, texts in slices(batch):
                counts, digests = [], []
                for text in texts:
                    own = {line_hash(x, least) for x in text.encode().split(b"\n")}
                    own.discard(None)
                    counts.append(len(own))
                    digests.append(b"".join(sorted(own)))
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                rows = pa.array(np.repeat(np.arange(len(texts)), counts))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in (0, 1)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "mark", *HASH])

    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    made = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, mark long, h1 long, h2 long")
    return made.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


class LineRuns:
    """Sorted runs (h1, h2, n, keeper) by level: n documents hold the key, keeper is the largest id among them.

    n may be too small where it is min_docs or more already. Two batches must not hold the same document.
    """

    def __init__(self, shelf: Shelf, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.shelf, self.spark, self.min_docs, self.fanout = shelf, shelf.spark, min_docs, fanout
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"lintweave_lines_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.shelf.root}/{name}").option("compression", "zstd").saveAsTable(name)
        self.shelf.names.add(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.shelf.drop(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Read as files, not as bucketed tables: Spark 4.1 takes a union of bucketed scans to be bucketed and mixes its partitions up."""
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(f"{self.shelf.root}/{x}" for x in names))
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")) if len(names) > 1 else rows

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def news(self, rows: DataFrame) -> DataFrame:
        """(h1, h2, n, keeper) of a batch (h1, h2, doc_id), without what one of the runs makes irrelevant."""
        own = rows.select(*HASH, "doc_id").distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        for name in self.names():
            run = self.spark.table(name).filter(F.col("n") >= self.min_docs).select(*(F.col(x).alias(f"run_{x}") for x in (*HASH, "keeper")))
            told = F.col("keeper").isNull() | F.coalesce(F.col("run_keeper") >= F.col("keeper"), F.lit(False))
            own = own.join(run, (F.col("h1") == F.col("run_h1")) & (F.col("h2") == F.col("run_h2")) & told, "left_anti")
        return own

    def add(self, rows: DataFrame) -> None:
        """A batch becomes a run of what it tells; full levels are compacted."""
        self._write(self.news(rows), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            for name in full:
                self._forget(name)
            level += 1

    def shared(self) -> DataFrame:
        """(h1, h2, keeper) of the keys that enough documents hold."""
        return self._merged(self.names()).filter(F.col("n") >= self.min_docs).select(*HASH, "keeper")

    def drop(self) -> None:
        """Deletes all runs."""
        for name in self.names():
            self._forget(name)
        self.levels = []


def _kept(raw: bytes, gone: set[bytes], least: int) -> tuple[int, bytes]:
    lines = raw.split(b"\n")
    own = [x for x in lines if line_hash(x, least) not in gone]
    return len(lines) - len(own), b"\n".join(own)


def _rewritten(rows: DataFrame, least: int) -> DataFrame:
    """(doc_id, text, gone) to (doc_id, n_lines, n_dropped, text)."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, texts in slices(batch):
                lists, counts, dropped, kept = part.column(2), [], [], []
                for i, text in enumerate(texts):
                    counts.append(text.count("\n") + 1)
                    gone = lists[i].values if lists[i].is_valid else None
                    if gone is None or not len(gone):
                        dropped.append(0)
                        kept.append(text)
                        continue
                    pairs = np.column_stack([gone.field(x).to_numpy() for x in HASH]).astype("<i8")
                    n, own = _kept(text.encode(), {x.tobytes() for x in pairs}, least)
                    dropped.append(n)
                    kept.append(own.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, shelf: Shelf, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row: text without the lines that another document keeps."""
    source = id_text(docs, id_col, text_col)
    keys = shelf.put(line_keys(source, batches, min_chars), "keys", ["batch"])
    runs = LineRuns(shelf, min_docs, fanout)
    for i in range(batches):
        runs.add(keys.filter(F.col("batch") == i))
    shared = shelf.put(runs.shared(), "shared")
    runs.drop()
    hits = keys.join(shared, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = shelf.put(hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(*HASH)).alias("gone")), "gone")
    shelf.drop("shared")
    shelf.drop("keys")
    gone = gone.select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "gone")
    rows = source.join(gone, F.col("doc_id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("own_mark")), "left")
    return _rewritten(rows.select("doc_id", "text", "gone"), min_chars)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that others keep for it."""
    kept = dedup_lines(documents(spark, sf_dir), Shelf(spark, "op11"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = """
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own FROM l),
    c AS (SELECT own, max(doc_id) AS keeper FROM k WHERE length(own) >= 20 GROUP BY own HAVING count(DISTINCT doc_id) >= 3),
    g AS (SELECT rid, doc_id, line, pos, c.own IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN c USING (own))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM g GROUP BY rid, doc_id"""
