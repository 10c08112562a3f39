"""Write modes on the driver's tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import store
from lintweave.operators.snapshots import Snapshots
from lintweave.sources.tables import table
from lintweave.sources.work import shared_folder


def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Finished orders as stored rows, large orders as new ones with another price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.filter("o_orderstatus = 'F'"), orders.filter("o_totalprice > 200000").withColumn("o_totalprice", F.col("o_totalprice") + 1)


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace stored ones with their key."""
    return store.upsert(*_priced(spark, sf_dir), ["o_orderkey"])


def store_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows with new keys are added."""
    return store.insert_ignore(*_priced(spark, sf_dir), ["o_orderkey"])


def store_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of the first thousand keys go, then the new ones are upserted."""
    return store.scoped_replace(*_priced(spark, sf_dir), F.col("o_orderkey") < 1000, ["o_orderkey"])


def store_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of order and part are judged where a line with a large quantity holds them, in either order."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.lit("pending").alias("status")).distinct()
    judged = lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b"))
    return store.flip_status(pairs, judged, "a", "b")


def store_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash isn't stored, or is another; stored are those of even ids, of every third without its last sign."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.filter("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?s).\z", "")).otherwise(F.col("text")), 256).alias("h"))
    return store.missing_or_stale(docs.select("doc_id", F.sha2("text", 256).alias("h")), stored, "doc_id", "h")


def _snapshots(spark: SparkSession, sf_dir: str) -> Snapshots:
    """Three versions: finished orders and all line numbers; large orders in place of all, lines of returned ones only, in
    one step; then upserts of urgent orders and further lines."""
    kept = Snapshots(spark, f"{shared_folder(spark)}/lintweave-snapshots-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    with kept.change() as c:
        c.replace("orders", orders.filter("o_orderstatus = 'F'"))
        c.replace("lines", lines.filter("l_returnflag <> 'R'"))
    with kept.change() as c:
        c.clear()
        c.add("orders", orders.filter("o_totalprice > 100000"))
        c.add("lines", lines.filter("l_returnflag = 'R'"))
    with kept.change() as c:
        c.upsert("orders", orders.filter("startswith(o_orderpriority, '1')").withColumn("o_totalprice", F.lit(0)), ["o_orderkey"])
        c.add("lines", lines.filter("l_returnflag = 'A'"))
    return kept


def snapshot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the last version, as written and read again."""
    return _snapshots(spark, sf_dir).read("orders")


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and keys of both tables in each version, and in one after all is cleared."""
    kept = _snapshots(spark, sf_dir)
    with kept.change() as c:
        c.clear()
    per = []
    for v in kept.versions():
        for name, key in (("lines", "l_orderkey"), ("orders", "o_orderkey")):
            per.append(kept.read(name, v).agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).select(F.lit(v).alias("version"), F.lit(name).alias("name"), "n", "keys"))
    return reduce(DataFrame.unionByName, per)


QUERIES = {f.__name__: f for f in (store_upsert, store_ignore, store_scoped, store_flip, store_todo, snapshot_orders, snapshot_versions)}
_S = """WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    n AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_totalprice > 200000)"""
ORACLE_SQL = {
    "store_upsert": _S + " SELECT * FROM n UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)",
    "store_ignore": _S + " SELECT * FROM s UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)",
    "store_scoped": _S + " SELECT * FROM n UNION ALL SELECT * FROM s WHERE o_orderkey >= 1000 AND o_orderkey NOT IN (SELECT o_orderkey FROM n)",
    "store_flip": """SELECT DISTINCT a.l_orderkey AS a, a.l_partkey AS b, CASE WHEN EXISTS (SELECT 1 FROM lineitem j WHERE j.l_quantity > 45 AND
        ((j.l_orderkey = a.l_orderkey AND j.l_partkey = a.l_partkey) OR (j.l_orderkey = a.l_partkey AND j.l_partkey = a.l_orderkey))) THEN 'judged' ELSE 'pending' END AS status FROM lineitem a""",
    "snapshot_orders": """SELECT o_orderkey, o_orderstatus, CASE WHEN starts_with(o_orderpriority, '1') THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders
        WHERE starts_with(o_orderpriority, '1') OR o_totalprice > 100000""",
    "snapshot_versions": """WITH v AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS version), o AS (SELECT o_orderkey AS k, unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN 1 END, CASE WHEN o_totalprice > 100000 THEN 2 END,
        CASE WHEN o_totalprice > 100000 OR starts_with(o_orderpriority, '1') THEN 3 END], lambda x: x IS NOT NULL)) AS version FROM orders),
        l AS (SELECT l_orderkey AS k, unnest(CASE l_returnflag WHEN 'R' THEN [2, 3] WHEN 'A' THEN [1, 3] ELSE [1] END) AS version FROM lineitem)
        SELECT v.version, 'lines' AS name, count(k) AS n, sum(k)::BIGINT AS keys FROM v LEFT JOIN l USING (version) GROUP BY 1 UNION ALL SELECT v.version, 'orders', count(k), sum(k)::BIGINT FROM v LEFT JOIN o USING (version) GROUP BY 1""",
    "store_todo": "SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0",
}
