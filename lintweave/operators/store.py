"""Write modes of stored relations: each returns the table's next content, to be written over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new replace rows of old with the same key; of rows of new that share a key the one last in order stays."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order)
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new whose key isn't in old are added; of those that share a key the first in order, without one any."""
    if order:
        rest = [x for x in new.columns if x not in (*keys, order)]
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col(f"_row.{x}").alias(x) for x in rest))
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def scoped_replace(old: DataFrame, new: DataFrame, scope: Column, keys: list[str]) -> DataFrame:
    """Rows of old in the scope go, then new is upserted; a null scope keeps the row."""
    return upsert(old.filter(~F.coalesce(scope, F.lit(False))), new, keys)


def flip_status(pairs: DataFrame, judged: DataFrame, a: str, b: str, status: str = "status", value: str = "judged") -> DataFrame:
    """Sets the status of pairs that are judged, in either order of the two."""
    ends = lambda df: df.withColumn("_x", F.least(a, b)).withColumn("_y", F.greatest(a, b))
    done = ends(judged).select("_x", "_y", F.lit(True).alias("_done")).distinct()
    out = ends(pairs).join(done, ["_x", "_y"], "left").withColumn(status, F.when(F.col("_done"), F.lit(value)).otherwise(F.col(status)))
    return out.select(*pairs.columns)


def missing_or_stale(rows: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows without a stored one, or whose digest differs from the stored one's."""
    known = stored.select(key, F.col(digest).alias("_stored"))
    return rows.join(known, key, "left").filter(F.col("_stored").isNull() | (F.col("_stored") != F.col(digest))).drop("_stored")


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of new, in the columns and types of old."""
    return new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema))


def cleared(old: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return old.limit(0)
