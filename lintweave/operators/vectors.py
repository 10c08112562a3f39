"""Exact cosine joins, pruned by angles to pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lintweave.sources.work import Work

#: Vectors of a block; a task multiplies two blocks, so many products at a time.
BLOCK_ROWS = 2048
PRODUCTS = 1 << 22
#: Blocks into which vectors are dealt at most, besides those that pivots and rings make: a vector is sent once for each
#: block that its own is compared with, so that their number must not grow with the table.
BLOCKS = 24
#: Blocks by hash, where angles rule out little: each vector is sent once for each of them, so that they are as few as give
#: every core some products. Of large tables there are more, so that a block's vectors stay within these bytes.
FEW = 8
BLOCK_BYTES = 1 << 26
#: Found pairs that a task hands on at once.
ROWS_OUT = 1 << 17
#: Pivots at most, and the vectors that they are chosen among (the ones with the smallest hashes); neither changes results.
PIVOTS = 32
SAMPLE = 2000
#: Angles are compared with this much to spare, more than rounding can move them.
SLACK = 1e-6


@dataclass
class Blocks:
    """rows (id, vector, own block), summary (own, dim, cell, lo, hi) and the pairs (i, j) of blocks that may hold a pair."""

    rows: DataFrame
    summary: DataFrame
    pairs: DataFrame


def _pivots(sample: list, most: int) -> dict[int, np.ndarray]:
    """Of each length, vectors that lie far from each other: each the farthest from those before it."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen, nearest = [0], np.arccos(np.clip(x @ x[0], -1, 1))
        while len(chosen) < min(most, len(x)) and nearest.max() > SLACK:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.arccos(np.clip(x @ x[chosen[-1]], -1, 1)))
        out[dim] = x[chosen]
    return out


def blocks(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, keep: tuple[str, ...] = ()) -> Blocks:
    """Deals vectors into blocks of few rows that lie near each other, and finds which blocks must be compared.

    A block holds vectors of one length whose nearest pivot is the same, at about the same angle; larger ones are split by
    hash. Angles are a metric: where a pivot's angles to two blocks are further apart than the threshold's angle, no pair
    between them can reach it. Blocks meet on bins of their angles to the pivots, an equi-join, then all pivots are tried.
    Where a vector would still go to more partners than there are blocks by hash alone, twice over, it is dealt by hash.
    Rows keep further columns (keep), and numbers that are floats stay floats.
    """
    work = Work(vectors.sparkSession, "cosine")
    v = F.col("vector")
    given = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"), *keep).filter((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))
    rows = rows.filter(F.col("id").isNotNull())
    count = rows.count()
    least, block_rows = block_rows, max(block_rows, -(-count // BLOCKS))
    n = -(-count // block_rows)
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    if n <= 1:
        own = work.put(rows.withColumn("own", F.concat_ws("/", F.size(v).cast("string"), F.lit("0"))))
        ones = own.select("own").distinct()
        return Blocks(own, ones, ones.select(F.col("own").alias("i"), F.col("own").alias("j")))
    few = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).collect()
    centres = _pivots([r.vector for r in few], min(pivots, 4 * n))
    k = max(map(len, centres.values()))

    @F.pandas_udf("array<double>")
    def angles(given: pd.Series) -> pd.Series:
        out = np.zeros((len(given), k))
        lengths = given.map(len).to_numpy()
        for dim, c in centres.items():
            at = np.nonzero(lengths == dim)[0]
            if len(at):
                x = np.stack(given.iloc[at].to_numpy())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out[at, : len(c)] = np.arccos(np.clip(x @ c.T, -1, 1))
        return pd.Series(list(out))

    sizes = F.create_map(*(F.lit(x) for dim, c in centres.items() for x in (dim, len(c))))
    known = rows.withColumn("d", angles("vector")).withColumn("dim", F.size("vector")).withColumn("own_d", F.slice("d", F.lit(1), F.coalesce(sizes[F.col("dim")], F.lit(1))))
    cell = (F.array_position("own_d", F.array_min("own_d")) - 1).cast("int")
    ring = F.floor(F.array_min("own_d") / F.lit(max(angle / 2, math.pi / 64))).cast("int")
    known = known.withColumn("cell", cell).withColumn("ring", ring).drop("own_d")
    group = ["dim", "cell", "ring"]
    parts = work.put(known.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts")))
    dealt = known.join(parts, group, "left").withColumn("own", F.concat_ws("/", *group, F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))))
    summary = work.put(_summary(dealt, k))
    pairs = work.put(_near(summary, k, angle))
    sent = lambda x: pairs.join(summary.select(F.col("own").alias(x), "n"), x)
    copies = sent("i").unionByName(sent("j").filter("i <> j")).agg(F.sum("n").alias("n")).first().n or 0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    few = max(FEW, math.isqrt(4 * cores), -(-count * 8 * max(centres) // BLOCK_BYTES))
    if copies > 2 * few * count:
        by_hash = work.put(rows.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / max(least, -(-count // few))).cast("long").alias("parts")))
        own = lambda p: F.concat_ws("/", "dim", p)
        dealt = rows.withColumn("dim", F.size("vector")).join(by_hash, "dim").withColumn("own", own(F.pmod(F.xxhash64("id"), "parts")))
        each = by_hash.select("dim", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        pairs = each.select("dim", "p", F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("q")).select(own("p").alias("i"), own("q").alias("j"))
        return Blocks(dealt.select("id", "vector", "own", *keep), each.select(own("p").alias("own"), "dim"), pairs)
    # angles that are made again may differ in their last digit, so that a row's block is written down before blocks are summed up
    stored = work.put(dealt.select("id", "vector", "own", "dim", "cell", *keep))
    summary = work.put(_summary(stored.withColumn("d", angles("vector")), k))
    return Blocks(stored.select("id", "vector", "own", *keep), summary, _near(summary, k, angle))


def _summary(dealt: DataFrame, k: int) -> DataFrame:
    ends = [F.array(*(f(F.col("d")[i]) for i in range(k))).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return dealt.groupBy("own", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), *ends)


def _near(summary: DataFrame, k: int, angle: float) -> DataFrame:
    """(i, j) of blocks that may hold a pair."""
    width = max(angle, math.pi / 64)
    span = lambda low, high: F.sequence(F.floor(low / width), F.floor(high / width))
    reach = F.explode(span(F.get("lo", F.col("cell")) - angle - SLACK, F.get("hi", F.col("cell")) + angle + SLACK)).alias("bin")
    asking = summary.select("dim", F.col("cell").alias("pivot"), F.col("own").alias("a"), reach)
    lies = summary.select("dim", F.col("own").alias("b"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pivot"))
    lies = lies.select("dim", "pivot", "b", F.explode(span(F.get("lo", F.col("pivot")), F.get("hi", F.col("pivot")))).alias("bin"))
    near = asking.join(lies, ["dim", "pivot", "bin"]).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    side = lambda x: summary.select(F.col("own").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    apart = lambda p: F.greatest(F.get("lo_i", p) - F.get("hi_j", p), F.get("lo_j", p) - F.get("hi_i", p))
    pairs = near.join(side("i"), "i").join(side("j"), "j").filter(F.forall(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: apart(p) <= angle + SLACK))
    return pairs.select("i", "j")


def cosine_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, similarity) with a < b and cosine >= threshold, exactly; columns to keep come as x_a and x_b.

    Null, empty and zero vectors, and those with a null or NaN in them, are similar to nothing, as are vectors of different
    lengths. Each pair of blocks that may hold a pair is one task's matrix product, so that only pairs over the threshold
    become rows. A row is sent to as many tasks as its block has partners, whose number grows only where blocks would not
    fit a task; the products do, with the table's square. They are made of short floats, those near the threshold again.
    """
    made = blocks(vectors, threshold, id_col, vector_col, block_rows, pivots, keep)
    both = made.pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    both = Work(vectors.sparkSession, "cosine").put(both)
    dealt = made.rows.join(both, "own").select("i", "j", "own", "id", "vector", *keep)

    def numbers(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return x, size, unit.astype(np.float32)

    def over(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, unit_x: np.ndarray, unit_y: np.ndarray) -> Iterator[tuple]:
        """The places in x and y, and the cosines, of pairs that reach the threshold."""
        dim = x.shape[1]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            # more to spare than products of short floats can be wrong by
            at = np.divmod(np.flatnonzero(unit_x @ unit_y.T >= np.float32(threshold - (dim + 8) * 2e-7)), len(y))
            each = max(1, PRODUCTS // dim)
            for n in range(0, len(at[0]), each):
                i, j = at[0][n : n + each], at[1][n : n + each]
                like = np.einsum("ij,ij->i", x[i], y[j]) / size_x[i] / size_y[j]
                found = like >= threshold
                yield i[found], j[found], like[found]

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(parts))
        i, j = part["i"][0], part["j"][0]
        left, right = part.filter(pa.compute.equal(part["own"], i)), part.filter(pa.compute.equal(part["own"], j))
        if not len(left) or not len(right):
            return
        all_rows = pa.concat_tables([left, right]).select(["id", *keep]).combine_chunks()
        (x, size_x, unit_x), (y, size_y, unit_y) = numbers(left), numbers(right)
        ids, others = (p["id"].to_numpy() for p in (left, right))
        step = max(1, PRODUCTS // len(y))
        for k in range(0, len(x), step):
            own = slice(k, k + step)
            for m, n, like in over(x[own], y, size_x[own], size_y, unit_x[own], unit_y):
                a, b = ids[k + m], others[n]
                wanted = (a < b if i == j else a != b).astype(bool)
                first = (a < b).astype(bool)[wanted]
                m, n, like = k + m[wanted], len(left) + n[wanted], like[wanted]
                one, two = np.where(first, m, n), np.where(first, n, m)
                for r in range(0, len(like), ROWS_OUT):
                    sides = [all_rows.take(pa.array(at[r : r + ROWS_OUT])).combine_chunks() for at in (one, two)]
                    columns = [s["id"] for s in sides] + [pa.chunked_array([pa.array(like[r : r + ROWS_OUT])])] + [s[c] for c in keep for s in sides]
                    yield from pa.Table.from_arrays(columns, names).to_batches()

    names = ["a", "b", "similarity", *(f"{c}_{x}" for c in keep for x in "ab")]
    kind = lambda c: made.rows.schema[c].dataType.simpleString()
    schema = f"a {kind('id')}, b {kind('id')}, similarity double" + "".join(f", {c}_{x} {kind(c)}" for c in keep for x in "ab")
    return dealt.groupBy("i", "j").applyInArrow(multiply, schema)


def similar_terms(terms: DataFrame, threshold: float, most: int = 500, **how) -> DataFrame:
    """(term_a, term_b, similarity): the most similar pairs of terms (term, vector), but for those that differ in case only; ties by terms."""
    found = cosine_pairs(terms, threshold, "term", "vector", **how).filter("lower(a) <> lower(b)")
    rows = found.select(F.col("a").alias("term_a"), F.col("b").alias("term_b"), F.round("similarity", 4).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "term_a", "term_b").limit(most)


def similar_sections(sections: DataFrame, threshold: float, most: int = 1000, min_body: int = 60, **how) -> DataFrame:
    """(section_a, section_b, path_a, path_b, similarity): the most similar pairs of sections (section_id, path, body,
    vector) of different files, but for those whose body has fewer characters than min_body; ties by sections."""
    own = sections.filter(F.length(F.regexp_replace("body", r"(?U)^\s+|\s+$", "")) >= min_body).select("section_id", "path", "vector")
    # texts are read once, and never shuffled; a pair knows its files
    own = Work(sections.sparkSession, "sections").put(own)
    rows = cosine_pairs(own, threshold, "section_id", "vector", keep=("path",), **how).filter("path_a <> path_b")
    rows = rows.select(F.col("a").alias("section_a"), F.col("b").alias("section_b"), "path_a", "path_b", F.round("similarity", 4).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "section_a", "section_b").limit(most)
