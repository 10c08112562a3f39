"""Operator 5: exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. All blocks are sorted and named by their rank among the distinct
ones; then adjacent pairs of names are named in the same way, level by level, until each text has one name. Two texts of
the same number of blocks have the same name if and only if they are equal: names stand for contents, not for hashes, so
there are no collisions. They depend on the texts alone, not on partitions or on the order of rows. The number of levels
is the logarithm of the longest text's blocks; only texts that still have more than one name take part in a level.

Blocks go through one shuffle. Their order is that of their first bytes, then of a 64-bit hash, then of their contents;
ranges are drawn by (first bytes, hash, row), so that a block that very many rows hold is spread over as many ranges as it
needs, and what Spark samples for them is some 50 bytes a row and no contents. Each range ranks its own rows by contents; its
first and last (first bytes, hash) and its number of distinct blocks, a row for each range, tell the driver how many names come
before it. Where ranges meet within one hash, Spark compares the contents on both sides; if they differ (two contents with equal
first bytes and equal hashes, at the edge of a range), the level is dealt again by contents, in the same order.
Null texts are equal to empty ones (one empty block). Of equal
texts the row with the largest id stays, and all of those that tie on it; a null id is smaller than all. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Shelf, documents, id_text

BLOCK_BYTES = 4096
#: Of a block, what its order begins with; the rest of the order is its hash, then its contents.
HEAD_BYTES = 16


def _named(rows: DataFrame, keys: list[str], shelf: Shelf, name: str, few: list[str] | None = None) -> DataFrame:
    """rows with the rank of their key among the distinct ones as name, in place of keys. Keys aren't null; row is a column.

    few, the first of keys (or all of them, if it is not given), draw the ranges and are all that the driver sees of a key.
    """
    few = few or keys
    rest = [x for x in rows.columns if x not in keys]
    dealt = rows.select(*keys, *rest).repartitionByRange(*few, "row").sortWithinPartitions(*keys)
    n, k = len(keys), len(few)

    def run(batches):
        part, local, first, last = TaskContext.get().partitionId(), -1, None, None
        # whether the first and the last rows with equal few hold several keys
        mixed_first = mixed_last = passed = False
        for batch in batches:
            if not batch.num_rows:
                continue
            new, new_few = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i in range(n):
                column = batch.column(i)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                if i + 1 == k:
                    new_few[:] = new
            opening = [batch.column(i)[0].as_py() for i in range(n)]
            new[0] = opening != last
            new_few[0] = first is not None and opening[:k] != last[:k]
            within = new & ~new_few
            within[0] &= first is not None
            first = first or opening
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(n)]
            starts = np.flatnonzero(new_few)
            if not passed:
                mixed_first |= bool(within[: starts[0] if len(starts) else None].any())
            mixed_last = bool(within[starts[-1] :].any()) if len(starts) else mixed_last or bool(within.any())
            passed |= len(starts) > 0
            rank = pa.array(local + np.cumsum(new), pa.int64())
            nothing = [pa.nulls(batch.num_rows, t) for t in [pa.bool_(), *key_kinds * 2]]
            local = rank[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], pa.array([part] * batch.num_rows, pa.int32()), rank, *nothing], names)
        if first:
            # of the range: its number of distinct keys less 1, whether an end is mixed, its first key and its last
            empty = [pa.nulls(1, t) for t in kinds]
            ends = [pa.array([x], t) for x, t in zip([mixed_first or mixed_last, *first, *last], [pa.bool_(), *key_kinds * 2], strict=True)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([local], pa.int64()), *ends], names)

    edge = lambda end, of: [f"{end}_{x}" for x in of]
    names = [*rest, "part", "local", "mixed", *edge("first", keys), *edge("last", keys)]
    kinds, key_kinds = ([to_arrow_type(rows.schema[x].dataType) for x in xs] for xs in (rest, keys))
    spelled = [f"{x} {rows.schema[x].dataType.simpleString()}" for x in rest] + ["part int", "local long", "mixed boolean"] + [f"{end}_{x} {rows.schema[x].dataType.simpleString()}" for end in ("first", "last") for x in keys]
    made = shelf.put(dealt.mapInArrow(run, ", ".join(spelled)), name)
    # a row for each range
    edges = made.filter("mixed IS NOT NULL")
    # in the order of parts, which is that of the ranges: driver memory is some 100 bytes a range
    ends = [(r[0], r[1], r[2], list(r[3 : 3 + k]), list(r[3 + k :])) for r in edges.select("part", "local", "mixed", *edge("first", few), *edge("last", few)).collect()]
    ends.sort(key=lambda r: r[0])
    if k < n:
        mixed = any((a[2] or b[2]) and a[4] == b[3] for a, b in pairwise(ends))
        at = lambda end: F.struct(*(F.col(f"{end}_{x}").alias(x) for x in keys))
        whole = F.struct(*keys[k:])
        apart = edges.select(F.inline(F.array(at("first"), at("last")))).groupBy(*few).agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low <> high")
        # a single range may hold several keys of one hash; it has ranked them
        if mixed or (any(a[4] == b[3] for a, b in pairwise(ends)) and not apart.isEmpty()):
            return _named(rows, keys, shelf, f"{name}-whole")
    total, before, previous = 0, [], None
    for part, local, _, first, last in ends:
        total -= first == previous
        before.append((part, total))
        total, previous = total + local + 1, last
    offsets = made.sparkSession.createDataFrame(before, "part int, before long")
    return made.filter("mixed IS NULL").join(F.broadcast(offsets), "part").select(*rest, (F.col("before") + F.col("local")).alias("name"))


def identities(docs: DataFrame, shelf: Shelf, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(doc_id, n_blocks, name, text_sha256): equal (n_blocks, name) if and only if the texts are equal, whatever hashed says."""
    # row tells repeated rows apart; it is computed once, as level 0 is written
    source = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int")
    cut = source.select(
        "row",
        "doc_id",
        F.sha2("bytes", 256).alias("text_sha256"),
        n.alias("n_blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("bytes").substr(i * block + 1, F.lit(block)))).alias("pos", "block"),
    )
    digest = F.when(F.col("pos") == 0, F.unhex("text_sha256")).alias("digest")
    cut = cut.select("row", "doc_id", "n_blocks", "pos", F.col("block").substr(1, HEAD_BYTES).alias("head"), hashed("block").alias("hash"), "block", digest)
    level = _named(cut, ["head", "hash", "block"], shelf, "level0", ["head", "hash"])
    out = ("doc_id", "n_blocks", "name", "digest")
    done = level.filter("n_blocks = 1").select(*out)
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    rest = level.filter("n_blocks > 1").select("row", "doc_id", "n_blocks", "pos", "name", "digest")
    depth = 0
    while (longest - 1) >> depth:
        half = F.col("pos").bitwiseAND(F.lit(1))
        pairs = rest.groupBy("row", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(half == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("digest").alias("digest"),
        )
        depth += 1
        rest = _named(pairs, ["left", "right"], shelf, f"level{depth}")
        ready = F.shiftright(F.col("n_blocks") - 1, depth) == 0
        done = done.unionByName(rest.filter(ready).select(*out))
        rest = rest.filter(~ready)
    return done.select("doc_id", "n_blocks", "name", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, shelf: Shelf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    named = identities(docs, shelf, id_col, text_col)
    groups = shelf.put(named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op5_blocknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-duplicate groups of all documents."""
    return exact_groups(documents(spark, sf_dir), Shelf(spark, "op5"))


OP5_SQL = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY text)"""
