from lintweave.operators import formal, idindex, markdown, store
from pyspark.sql import functions as F

TEXT = """# ADR-001 Choice
## 2. Tests
| ID | what |
| **TEST-AA-01** | a |
| `TEST-AA-02` | b |
| TEST-AA-04 | c |
| TEST-AA-04 | again |
| BENCH-X-01 | d |
## 3. Use
see TEST-AA-01..TEST-AA-02 and TEST-ZZ-09, also TEST-AA-02..TEST-AA-01
```
TEST-QQ-01
```
bad TEST-AA-1
"""


def test_identifiers(spark):
    rows = markdown.lines(spark.createDataFrame([("a.md", TEXT)], "path string, content string"))
    found = idindex.tokens(rows)
    got = sorted((r.rule_code, r.line, r.token) for r in idindex.issues(found).collect())
    assert got == sorted([
        ("ID-INVALID-FORMAT", 14, "TEST-AA-1"), ("ID-INVALID-RANGE", 10, "TEST-AA-02"), ("ID-DUPLICATE-DEFINITION", 6, "TEST-AA-04"), ("ID-DUPLICATE-DEFINITION", 7, "TEST-AA-04"),
        ("ID-UNRESOLVED-REFERENCE", 10, "TEST-ZZ-09"), ("ID-UNREFERENCED-DEFINITION", 6, "TEST-AA-04"), ("ID-UNREFERENCED-DEFINITION", 7, "TEST-AA-04"),
        ("ID-UNREFERENCED-DEFINITION", 8, "BENCH-X-01"), ("ID-SERIAL-GAPS", 1, "TEST-AA"),
    ])
    assert {(r.family, r.series, r.next_id) for r in idindex.next_ids(found).collect()} == {("TEST", "AA", "05"), ("BENCHMARK", "X", "02"), ("ADR", "", "002")}


def test_formal(spark):
    t = spark.createDataFrame([("m", "a", "b", False), ("m", "a", "c", False), ("m", "b", "a", False), ("m", "c", "bad", True), ("n", "x", "y", False)], "model string, source string, target string, guarded boolean")
    states = spark.createDataFrame([("m", s) for s in ("a", "b", "c", "bad")] + [("n", s) for s in ("x", "y", "z")], "model string, state string")
    start = spark.createDataFrame([("m", "a"), ("n", "x")], "model string, state string")
    assert {(r.model, r.unreachable, r.branching, r.verdict) for r in formal.soundness(states, start, t).collect()} == {("m", 0, 2, "PASS"), ("n", 1, 1, "UNSOUND")}
    bad = spark.createDataFrame([("m", "bad")], "model string, state string")
    assert {(r.model, r.verdict) for r in formal.mutation(start, t, bad).collect()} == {("m", "EFFECTIVE"), ("n", "USELESS")}
    assert {r.state for r in formal.eventually(bad, t).collect()} == {"a", "b", "c", "bad"}
    assert {r.state for r in formal.inevitable(states, bad, t).collect()} == {"c", "bad"}
    good = states.filter("state <> 'bad'")
    assert {r.state for r in formal.always(states, good, t).collect()} == {"x", "y", "z"}


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, ord int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.upsert(old, new, ["k"], "ord")) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(store.scoped_replace(old, new.filter("k = 3").drop("ord"), F.col("v") == "a", ["k"])) == [(2, "b"), (3, "z")]
    assert [k for k, _ in rows(store.insert_ignore(old, new.drop("ord"), ["k"]))] == [1, 2, 3]
