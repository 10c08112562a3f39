"""Reachability over edge tables by frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(initial: DataFrame, edges: DataFrame, limit: int = 1000) -> DataFrame:
    """(model, state) reached from initial (model, state) along edges (model, source, target), itself included.

    Each round follows the edges of the frontier and drops what is known; it stops when nothing is new. Every round is
    checkpointed where a checkpoint folder is set. Raises if limit rounds don't suffice.
    """
    keep = (lambda df: df.checkpoint()) if edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda df: df.persist())
    seen = frontier = keep(initial.select("model", "state").distinct())
    steps = edges.select("model", F.col("source").alias("state"), "target").distinct()
    for _ in range(limit):
        new = frontier.join(steps, ["model", "state"]).select("model", F.col("target").alias("state")).distinct()
        frontier = keep(new.join(seen, ["model", "state"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = keep(reduce(DataFrame.unionByName, (seen, frontier)))
    raise ValueError(f"more than {limit} rounds")
