"""Graph checks: tiers, traceability, state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintweave.operators.reach import reachable
from lintweave.operators import batches, graphs
from lintweave.sources.tables import table


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose customer's tier (region) is below their supplier's, counted by nations."""
    nation = table(spark, sf_dir, "nation")
    side = lambda k, n, t: nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n), F.col("n_regionkey").alias(t))
    customer = table(spark, sf_dir, "customer").join(side("c_nationkey", "source", "source_tier"), "c_nationkey").select("c_custkey", "source", "source_tier")
    supplier = table(spark, sf_dir, "supplier").join(side("s_nationkey", "target", "target_tier"), "s_nationkey").select("s_suppkey", "target", "target_tier")
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = edges.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.filter("source_tier < target_tier").groupBy("source", "target", "source_tier", "target_tier").agg(F.count(F.lit(1)).alias("n"))


def trace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the number of their references and their state."""
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    state = F.when(F.col("o_orderkey").isNull(), "Undefined").when(F.col("n").isNull(), "Unreferenced").otherwise("Satisfied")
    return rows.select(F.coalesce("o_orderkey", "l_orderkey").alias("item"), F.coalesce("n", F.lit(0)).alias("refs"), state.alias("state"))


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference of each part: by order, then line; all its fields from one row."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(first, F.countDistinct("l_orderkey").alias("files")).select("l_partkey", "first.*", "files")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("source"), after.alias("target")).filter("target IS NOT NULL")


def state_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that each conversation's machine reaches from its first role."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("state"))
    return reachable(first.select(F.col("conv_id").alias("model"), "state"), _turns(spark, sf_dir).withColumnRenamed("conv_id", "model"))


def state_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest number of other states that follow a state, by conversation."""
    per = _turns(spark, sf_dir).filter("source <> target").groupBy("conv_id", "source").agg(F.countDistinct("target").alias("n"))
    return per.groupBy("conv_id").agg(F.max("n").alias("branching"), F.count(F.lit(1)).alias("states"))


def keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted set of parts of each order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parts"))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders define the part of their first line and refer to those of others; lines of nation 0's suppliers all refer to part 1, too."""
    lines = table(spark, sf_dir, "lineitem")
    own = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.when(F.col("l_linenumber") == 1, "defines").otherwise("refers_to").alias("relation"))
    hub = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.lit("p1").alias("target"), F.lit("refers_to").alias("relation"))
    return own.unionByName(hub)


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's counts, and the first five orders that define it and that refer to it; one is a hub of all orders."""
    joined = {x: F.array_join(x, ",") for x in ("defined_in", "referred_in")}
    return graphs.neighbours(_uses(spark, sf_dir), 5).withColumns(joined)


def graph_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the first 150 nodes: orders and parts by number."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    return graphs.induced(orders.unionByName(parts), _uses(spark, sf_dir), 150)[1]


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines in greedy batches of quantities: a sum of 90 at most, four lines at most."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return batches.greedy(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "size"], F.col("size"), 90, 4)


QUERIES = {f.__name__: f for f in (hierarchy_edges, trace_matrix, representative, state_reach, state_branching, keyword_map, graph_neighbours, graph_induced, request_batches)}
_T = "WITH t AS (SELECT conv_id, role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations)"
_U = """WITH u AS (SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, CASE WHEN l_linenumber = 1 THEN 'defines' ELSE 'refers_to' END AS relation FROM lineitem
    UNION SELECT 'o' || l_orderkey, 'p1', 'refers_to' FROM lineitem)"""
ORACLE_SQL = {
    "graph_neighbours": _U + """ SELECT target AS item, count(*) FILTER (relation = 'defines') AS n_defined, count(*) FILTER (relation = 'refers_to') AS n_referred, 1 + count(*) AS total_nodes,
        array_to_string(list_sort(coalesce(list(source) FILTER (relation = 'defines'), []))[1:5], ',') AS defined_in, array_to_string(list_sort(coalesce(list(source) FILTER (relation = 'refers_to'), []))[1:5], ',') AS referred_in FROM u GROUP BY target""",
    "graph_induced": _U + """, n AS (SELECT id FROM (SELECT 'o' || o_orderkey AS id, o_orderkey AS ord FROM orders UNION ALL SELECT 'p' || p_partkey, p_partkey FROM part) ORDER BY ord, id LIMIT 150)
        SELECT source, target, relation FROM u WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""",
    "request_batches": """WITH RECURSIVE n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS pos FROM lineitem),
        g AS (SELECT *, size AS total, 1 AS held, 0 AS batch FROM n WHERE pos = 1 UNION ALL SELECT n.*, CASE WHEN g.total + n.size > 90 OR g.held = 4 THEN n.size ELSE g.total + n.size END, CASE WHEN g.total + n.size > 90 OR g.held = 4 THEN 1 ELSE g.held + 1 END,
            CASE WHEN g.total + n.size > 90 OR g.held = 4 THEN g.batch + 1 ELSE g.batch END FROM g JOIN n ON n.l_suppkey = g.l_suppkey AND n.pos = g.pos + 1)
        SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, size, CAST(batch AS INTEGER) AS batch FROM g""",
    "hierarchy_edges": """SELECT a.n_name AS source, b.n_name AS target, a.n_regionkey AS source_tier, b.n_regionkey AS target_tier, count(*) AS n
        FROM lineitem, orders, customer, supplier, nation a, nation b WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey
        AND a.n_nationkey = c_nationkey AND b.n_nationkey = s_nationkey AND a.n_regionkey < b.n_regionkey GROUP BY ALL""",
    "trace_matrix": """SELECT item, max(refs) AS refs, CASE WHEN bool_or(d) THEN CASE WHEN max(refs) > 0 THEN 'Satisfied' ELSE 'Unreferenced' END ELSE 'Undefined' END AS state
        FROM (SELECT o_orderkey AS item, 0 AS refs, true AS d FROM orders UNION ALL SELECT l_orderkey, count(*), false FROM lineitem GROUP BY 1) GROUP BY item""",
    "representative": """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, files FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k
        FROM lineitem) JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1) USING (l_partkey) WHERE k = 1""",
    "state_reach": _T.replace("WITH", "WITH RECURSIVE") + """, r AS (SELECT conv_id AS model, arg_min(role, turn) AS state FROM conversations GROUP BY 1
        UNION SELECT r.model, t.target FROM r JOIN t ON t.conv_id = r.model AND t.source = r.state WHERE t.target IS NOT NULL) SELECT model, state FROM r""",
    "state_branching": _T + """ SELECT conv_id, max(n) AS branching, count(*) AS states FROM (SELECT conv_id, source, count(DISTINCT target) AS n FROM t
        WHERE target <> source GROUP BY 1, 2) GROUP BY conv_id""",
    "keyword_map": "SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY 1",
}
