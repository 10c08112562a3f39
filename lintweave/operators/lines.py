"""Line-shaped operators: lines, fence parity, nearest smaller level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grown(rows: DataFrame) -> DataFrame:
    """rows as a join's side that is sorted and never broadcast: the planner takes the lines of texts for as few bytes as the texts' table."""
    return rows.hint("merge")


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with line_no (from 1) and line, a row for each line; a null text has none."""
    return docs.select("*", F.posexplode(F.split(text_col, "\n")).alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


def parity(lines: DataFrame, fence: Column, keys: list[str], order: str) -> DataFrame:
    """Adds is_fence and inside: an odd number of fence lines so far, the fence lines themselves not inside."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_fence", fence)
    return marked.withColumn("inside", ~F.col("is_fence") & (F.count_if("is_fence").over(so_far) % 2 == 1))


def nearest_smaller(rows: DataFrame, keys: list[str], order: str, level: str, levels: int) -> DataFrame:
    """Adds parent: the order value of the nearest row before with a smaller level (1 to levels), else null.

    One window: the last place of each level so far; the parent is the latest of those of smaller levels.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before) for k in range(1, levels)}
    seen = rows.withColumns({f"_last{k}": c for k, c in last.items()})
    best = F.greatest(*(F.when(F.col(level) > k, F.col(f"_last{k}")) for k in last), F.lit(None).cast("int"))
    return seen.withColumn("parent", best).drop(*(f"_last{k}" for k in last))
