"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(edges: DataFrame, shelf: Shelf, name: str = "cc") -> DataFrame:
    """(node, component): of each node in edges (a, b), the smallest node that it reaches.

    Each step joins edges with the smallest neighbour of their node, a pre-aggregated table, so that a node with very
    many neighbours is split by adaptive execution and its neighbours are never gathered. Steps repeat until a pair of
    them changes nothing; the edges of each are a table in the shared folder.
    """
    now = shelf.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    mark, step = None, 0
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shelf.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-large{step}")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = shelf.put(large, f"{name}-wide{step}")
        low = shelf.put(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small{step}")
        joined = large.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        step += 1
        now = shelf.put(small.filter("a <> b").distinct(), f"{name}{step}")
        for x in (f"{name}{step - 1}", *(f"{name}-{k}{step - 1}" for k in ("large", "wide", "small"))):
            shelf.drop(x)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
