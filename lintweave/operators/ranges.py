"""Joins of ranges with the points in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_ranges(ranges: DataFrame, points: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """ranges (low, high and others) joined with points (serial) where low <= serial <= high and keys are equal.

    An equi-join on buckets of a fixed width, of which a range takes those that it touches, with the bounds as a filter;
    no nested loop. width should be about a usual range's.
    """
    touched = F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))
    left = ranges.filter("low <= high").withColumn("_bucket", F.explode(touched))
    right = points.withColumn("_bucket", F.floor(F.col("serial") / width))
    return left.join(right, [*keys, "_bucket"]).filter("serial BETWEEN low AND high").drop("_bucket")
