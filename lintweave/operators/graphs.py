"""Neighbourhoods and cuts of the document graph: edges (source, target, relation), nodes (id, ord, type, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(item, n_defined, n_referred, total_nodes, defined_in, referred_in): what defines and refers to each target.

    Counts are exact and pre-aggregated; lists hold the first sources in order, at most limit, by a rank that Spark cuts before
    it shuffles, so that a hub's edges are never gathered. Repeated edges are one.
    """
    own = edges.filter("relation IN ('defines', 'refers_to')").select("target", "source", "relation").distinct()
    counts = own.groupBy("target").agg(F.count_if(F.col("relation") == "defines").alias("n_defined"), F.count_if(F.col("relation") == "refers_to").alias("n_referred"))
    few = own.withColumn("n", F.row_number().over(Window.partitionBy("target", "relation").orderBy("source"))).filter(F.col("n") <= limit)
    named = lambda r: F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.col("source"))))
    lists = few.groupBy("target").agg(named("defines").alias("defined_in"), named("refers_to").alias("referred_in"))
    return counts.join(lists, "target").select(F.col("target").alias("item"), "n_defined", "n_referred", (F.lit(1) + F.col("n_defined") + F.col("n_referred")).alias("total_nodes"), "defined_in", "referred_in")


def induced(nodes: DataFrame, edges: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """The first nodes in order, and the distinct edges with both ends among them."""
    first = nodes.orderBy("ord", "id").limit(most)
    ids = F.broadcast(first.select("id"))
    kept = edges.select("source", "target", "relation").distinct()
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return first, kept


# How kinds of nodes and relations are drawn.
KINDS = {"file": "Doc", "section": "Sec", "item": "Item"}
ARROWS = {"defines": "==>", "refers_to": "-.->|refers_to|", "links_to": "-->|links_to|", "contains": "-->"}


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 150) -> list[str]:
    """A diagram's lines: at most so many nodes, numbered in order, and the edges among them."""
    first, kept = induced(nodes, edges, most)
    rows = first.orderBy("ord", "id").collect()
    number = {r.id: f"N{i}" for i, r in enumerate(rows)}
    label = lambda x: (x or "").replace('"', "'").replace("[", "(").replace("]", ")")
    drawn = [f'    {number[r.id]}["{KINDS.get(r.type, r.type)}: {label(r.label)}"]' for r in rows]
    links = sorted((int(number[r.source][1:]), int(number[r.target][1:]), r.relation) for r in kept.collect())
    return ["graph TD", *drawn, *(f"    N{a} {ARROWS.get(x, '-->')} N{b}" for a, b, x in links)]


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): the whole graph, a line for each node and edge."""
    line = lambda part, df: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return line("node", nodes).unionByName(line("edge", edges.select("source", "target", "relation").distinct()))
