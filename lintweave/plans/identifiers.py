"""Identifier checks: orders are definitions, line items are references to them by series and serial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintweave.operators.ranges import expand_ranges
from lintweave.sources.tables import table


def id_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that no reference names."""
    used = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(
        F.lit("Identifier").alias("gate"), F.lit("WARNING").alias("severity"),
        F.lit("ID-UNREFERENCED-DEFINITION").alias("rule_code"), F.col("o_orderkey").alias("item"),
    )


def id_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each definition of an identifier that is defined more than once."""
    own = Window.partitionBy("l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count(F.lit(1)).over(own).alias("definitions"))
    return rows.filter("definitions > 1")


def id_serial_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with missing serials."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"), F.countDistinct("l_linenumber").alias("present")
    )
    missing = (F.col("high") - F.col("low") + 1 - F.col("present")).cast("long")
    return per.select("l_orderkey", "low", "high", missing.alias("missing")).filter("missing > 0")


def id_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to what isn't defined among finished orders."""
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return refs.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


def id_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's range of 40 keys from its first order, expanded to the orders that exist."""
    orders = table(spark, sf_dir, "orders")
    ranges = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("low")).withColumn("high", F.col("low") + 39)
    return expand_ranges(ranges, orders.select(F.col("o_orderkey").alias("serial")), width=64).select("o_custkey", F.col("serial").alias("o_orderkey"))


def id_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next free serial of each series, with two digits at least."""
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).cast("string").alias("n"))
    return top.select("l_orderkey", F.when(F.length("n") < 2, F.lpad("n", 2, "0")).otherwise(F.col("n")).alias("next_id"))


QUERIES = {f.__name__: f for f in (id_unreferenced, id_duplicate, id_serial_gaps, id_unresolved, id_range_expand, id_next)}
ORACLE_SQL = {
    "id_unreferenced": """
        SELECT 'Identifier' AS gate, 'WARNING' AS severity, 'ID-UNREFERENCED-DEFINITION' AS rule_code, o_orderkey AS item
        FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "id_duplicate": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, d.n AS definitions FROM lineitem l JOIN
        (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) d
        ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber""",
    "id_serial_gaps": """
        SELECT * FROM (SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high,
        CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS BIGINT) AS missing
        FROM lineitem GROUP BY l_orderkey) WHERE missing > 0""",
    "id_unresolved": """
        SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "id_range_expand": """
        SELECT r.o_custkey, o.o_orderkey FROM (SELECT o_custkey, min(o_orderkey) AS low FROM orders GROUP BY o_custkey) r
        JOIN orders o ON o.o_orderkey BETWEEN r.low AND r.low + 39""",
    "id_next": """
        SELECT l_orderkey, CASE WHEN max(l_linenumber) + 1 < 10 THEN '0' ELSE '' END || CAST(max(l_linenumber) + 1 AS VARCHAR) AS next_id
        FROM lineitem GROUP BY l_orderkey""",
}
