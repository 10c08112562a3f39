"""Neighbourhoods, cuts, greedy batches and tables against loops."""

import random

import pytest
from pyspark.sql import functions as F

from lintweave.operators import batches, gates, graphs, markdown


def test_hub(spark):
    """A hub of 100,000 edges has exact counts and short lists."""
    edges = spark.range(100_000).select(F.format_string("s%06d", "id").alias("source"), F.lit("item:A").alias("target"), F.when(F.col("id") % 4 == 0, "defines").otherwise("refers_to").alias("relation"))
    edges = edges.unionByName(edges.limit(10)).unionByName(spark.createDataFrame([("s1", "item:B", "refers_to"), ("f", "item:B", "contains")], edges.schema))
    got = {r.item: r for r in graphs.neighbours(edges, 3).collect()}
    a, b = got["item:A"], got["item:B"]
    assert (a.n_defined, a.n_referred, a.total_nodes, a.defined_in, a.referred_in) == (25_000, 75_000, 100_001, ["s000000", "s000004", "s000008"], ["s000001", "s000002", "s000003"])
    assert (b.n_defined, b.n_referred, b.defined_in, b.referred_in) == (0, 1, [], ["s1"])


def test_mermaid(spark):
    nodes = spark.createDataFrame([("a.md", 1, "file", "a.md"), ("sec", 2, "section", 'He said "x" [y]'), ("item:A", 3, "item", "A"), ("z", 9, "item", None)], "id string, ord int, type string, label string")
    edges = spark.createDataFrame([("a.md", "sec", "contains"), ("sec", "item:A", "defines"), ("sec", "item:A", "defines"), ("sec", "z", "refers_to"), ("a.md", "nowhere", "links_to")], "source string, target string, relation string")
    assert graphs.mermaid(nodes, edges, 3) == ["graph TD", '    N0["Doc: a.md"]', "    N1[\"Sec: He said 'x' (y)\"]", '    N2["Item: A"]', "    N0 --> N1", "    N1 ==> N2"]
    assert graphs.mermaid(nodes, edges, 0) == ["graph TD"]
    assert graphs.as_json(nodes, edges).count() == 8


@pytest.mark.parametrize(("budget", "most"), [(10, 100), (25, 3)])
def test_greedy(spark, budget, most):
    rng = random.Random(budget)
    items = {f"zero{i}": [0] * i for i in (1, 4, 101)} | {f"i{i}": [rng.choice((0, 1, 2, 5, 9, 12, None)) for _ in range(rng.randrange(1, 60))] for i in range(12)}
    if budget == 25:
        items["long"] = [rng.randrange(12) for _ in range(10_000)]
    want = {}
    for key, sizes in items.items():
        batch = total = held = 0
        for n, size in enumerate(sizes):
            if held and (total + (size or 0) > budget or held >= most):
                batch, total, held = batch + 1, 0, 0
            total, held = total + (size or 0), held + 1
            want[key, n] = batch
    rows = spark.createDataFrame([(k, n, s) for k, own in items.items() for n, s in enumerate(own)], "k string, n int, s int").repartition(3)
    got = {(r.k, r.n): r.batch for r in batches.greedy(rows, ["k"], ["n"], F.col("s"), budget, most).collect()}
    assert got == want


def test_requests(spark):
    items = spark.createDataFrame([("a", "m", 10), ("b", "m", 99), ("c", "other", 1)], "item_id string, mode string, tokens int")
    checks = spark.createDataFrame([(f"c{i}", "m", i != 3, 5 * i) for i in range(1, 6)], "check_id string, mode string, enabled boolean, tokens int")
    got = [(r.item_id, r.check_ids, r.tokens) for r in batches.requests(items, checks, 40, 2).orderBy("item_id", "batch").collect()]
    # 30 tokens are left for a's checks, none for b's
    assert got == [("a", ["c1", "c2"], 25), ("a", ["c4"], 30), ("a", ["c5"], 35), ("b", ["c1"], 104), ("b", ["c2"], 109), ("b", ["c4"], 119), ("b", ["c5"], 124)]
    assert batches.requests(items.limit(0), checks, 40, 2).count() == 0


TABLE = r"""a | b
| Keyword | Source |
|---|:-:|
| {K_A} | docs/a.md |
| {K_B} x \| y | [b.md](docs/b.md#part) |
{K_C} | `docs/a.md`, docs/b.md
no bars
| {K_D} | docs/a.md |

| Other | Source |
| --- |
| {K_E} | x |

| Source | Keyword |
| --- | --- |
| docs/none.md | {K_F} |
| | {K_G} |
```
| {K_H} | docs/a.md |
```"""


def test_tables(spark):
    files = [("docs/a.md", "# A\n<!-- definition: {K_A} -->\n{K_A}"), ("docs/b.md", "none"), ("docs/t.md", TABLE), ("docs/n.md", None)]
    c = gates.Corpus(spark.createDataFrame(files, "path string, content string"), [])
    rows = {(r.line_no, r.header_line, tuple(r.cells)) for r in markdown.table_rows(c.lines).collect()}
    assert rows == {(4, 2, ("{K_A}", "docs/a.md")), (5, 2, ("{K_B} x | y", "[b.md](docs/b.md#part)")), (6, 2, ("{K_C}", "`docs/a.md`, docs/b.md")), (16, 14, ("docs/none.md", "{K_F}")), (17, 14, ("", "{K_G}"))}
    assert {(r.keyword, r.source, r.line_no) for r in gates.registry(c).collect()} == {("K_A", "docs/a.md", 4), ("K_B", "docs/b.md", 5), ("K_C", None, 6), ("K_F", "docs/none.md", 16), ("K_G", None, 17)}
    found = {(r.rule_code, r.path, r.line) for r in gates.registry_issues(c).collect()}
    assert found == {("TRACE-INVALID-INDEX-LOCATION", "docs/t.md", 6), ("TRACE-INVALID-INDEX-LOCATION", "docs/t.md", 17), ("TRACE-INDEX-WITHOUT-DEFINITION", "docs/b.md", 1), ("TRACE-INDEX-WITHOUT-DEFINITION", "docs/none.md", 1)}


def test_greedy_shuffles_once(spark):
    """No rounds: no job runs before the rows are asked for, and a row crosses one shuffle."""
    rows = spark.range(3000).selectExpr("id % 3 AS k", "id AS n", "id % 7 AS s")
    spark.sparkContext.setJobGroup("greedy", "greedy")
    try:
        done = batches.greedy(rows, ["k"], ["n"], F.col("s"), 11, 3)
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert done.groupBy("k", "batch").agg(F.sum("s").alias("s"), F.count("*").alias("n")).filter("s > 11 OR n > 3").count() == 0
