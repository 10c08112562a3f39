"""Operators behind word variants, backing, groups, stores and reports."""

from lintweave.operators import evidence, formal, gates, report, review, store, typos
from lintweave.sources import groups


def test_katakana(spark):
    rows = [("a.md", 1, w, False, False) for w in ("コンピュータ", "コンピュータ と コンピューター", "サーバ サーバー", "`コンピューター`")]
    lines = spark.createDataFrame(rows, "path string, line_start int, line string, inside boolean, is_fence boolean")
    words = typos.words_of(lines, typos.KATAKANA)
    found = typos.katakana_variants(words)
    assert [tuple(r) for r in found.collect()] == [("コンピュータ", "コンピューター", 2, 1)]
    assert [(r.word, r.other) for r in typos.variants(words, found).collect()] == [("コンピューター", "コンピュータ")]


def test_english(spark):
    text = ["counter countes counted counts", "planner plannex planning", "value1 value2 other_x otherx", "Header Headex SIGNAL SIGNAX", "reading reader", "counter"]
    lines = spark.createDataFrame([("a.md", i, t, False, i == 5) for i, t in enumerate(text)], "path string, line_start int, line string, inside boolean, is_fence boolean")
    found = {(r.a, r.b, r.n_a, r.n_b) for r in typos.english_variants(typos.words_of(lines, typos.ENGLISH)).collect()}
    one = ["counted", "counter", "countes", "counts"]
    assert found == {(x, y, 1, 1) for x in one for y in one if x < y} | {("planner", "plannex", 1, 1)}


def test_backing(spark):
    docs = spark.createDataFrame([("a/b/x.md",), ("a/c/y.md",), ("a/c/z.md",), ("q/w.md",)], "path string")
    models = spark.createDataFrame([("a/b/formal/m.py", []), ("a/formal/n.py", ["a/c/z.md"]), ("formal/_hidden.py", []), ("q/formalities/o.py", [])], "model string, backs array<string>")
    found = formal.backing(docs, models)
    assert {tuple(r) for r in found.collect()} == {("a/b/x.md", "a/b/formal/m.py"), ("a/c/y.md", "a/formal/n.py"), ("a/c/z.md", "a/formal/n.py")}
    assert [tuple(r) for r in formal.ambiguous_backing(found, models).collect()] == [("a/c/y.md", "a/formal", 2)]


def test_evidence(spark):
    files = [("s/a.md", "{VERIFY_BENCHMARK}\n<!-- evidence: benchmark=run.py -->"), ("s/b.md", "{VERIFY_BENCHMARK}"), ("t/c.md", "{VERIFY_BENCHMARK}"), ("t/d.md", "see `other.py`, sub/x.json and ../s/run.py\n```\nno.py\n```\n[gone.py](s/run.py) http://a.b/c.py *star.py")]
    existing = spark.createDataFrame([("s/run.py",), ("t/benchmark/one.py",), ("deep/other.py",)], "path string")
    c = gates.Corpus(spark.createDataFrame(files, "path string, content string"), [], existing)
    assert [r.path for r in evidence.benchmark_missing(c).collect()] == ["s/b.md"]
    assert {(r.line, r.message) for r in evidence.dangling_artifacts(c).collect()} == {(1, "Missing: sub/x.json")}


def test_groups(spark):
    known = {"python_a": groups.Group(("src/",), (".py",)), "concept_b": groups.Group(), "formal_c": groups.Group(patterns=("m?.py",)), "tools": groups.Group()}
    assert groups.resolve(known) == groups.resolve(known, "*") == list(known)
    assert [groups.resolve(known, x) for x in ("python", "concepts", "model", "TOOLS", "b", "none")] == [["python_a"], ["concept_b"], ["formal_c"], ["tools"], ["concept_b"], []]
    files = spark.createDataFrame([("src/a.PY",), ("src/a.PY",), ("srcs/b.py",), ("x/m1.py",), ("src/c.cc",)], "path string")
    paths = lambda g, **k: sorted(r.path for r in groups.of_group(files, known[g], **k).collect())
    assert paths("python_a") == ["src/a.PY"] and paths("formal_c") == ["x/m1.py"] and len(paths("tools")) == 4
    assert paths("python_a", explicit=["srcs/b.py"]) == [] and paths("tools", explicit=[]) == []


def test_store_and_review(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z", 1), (2, "late", 9), (2, "early", 3)], "k int, v string, at int")
    assert sorted(tuple(r) for r in store.insert_ignore(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "early")]
    assert store.replace(old, new).schema == old.schema and store.cleared(old).count() == 0
    rows = spark.createDataFrame([("ü" * 250, "r"), ("x" * 40, "r"), ("", "r"), ("y" * 90, "r" * 200)], "c string, r string")
    assert [len(r.c) for r in review.fitted(rows, "c", "r", 110).collect()] == [50, 40, 0, 0]


def test_report(spark):
    issues = spark.createDataFrame([("Format", "ERROR", "a|b.md", 3, "R1", "two\nlines"), ("Format", "WARNING", "c.md", 12, "R2", None)], "gate string, severity string, path string, line int, rule_code string, message string")
    text = report.markdown_report(issues, ("Format", "Link"))
    assert "| 1 | 1 | 0 |" in text and "| Format | 1 | 1 | FAIL |\n| Link | 0 | 0 | PASS |" in text and "| Format | ERROR | a\\|b.md | 3 | R1 | two lines |" in text
    assert report.markdown_report(issues.limit(0), ("Link",)).count("None.") == 2


def test_first_of_ties(spark, tmp_path):
    """Of lines with one number, the one that the table holds first."""
    from lintweave.plans import assessments

    rows = [(900 + i % 5, 5.0 + (i * 7) % 11, 300, 1, i) for i in range(400)]
    lines = spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_orderkey long, l_linenumber int, n int")
    lines.coalesce(1).orderBy(gates.F.col("n").desc()).coalesce(1).drop("n").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {tuple(r) for r in assessments.store_first(spark, str(tmp_path)).collect()}
    assert found == {(900 + i % 5, 5.0 + (i * 7) % 11) for i in range(395, 400)}


def test_first_without_values(spark, tmp_path):
    """Null quantities, numbers and keys, as the SQL has them."""
    import duckdb

    from lintweave.plans import assessments

    rows = [(1, None, 300, 1), (1, 7.0, 300, 2), (2, 3.0, None, 1), (2, 4.0, 500, 1), (3, None, 400, 1), (4, 5.0, 400, None), (5, None, 10, 1), (5, 2.0, 900, 1)]
    for n, more in enumerate(([], [(None, 8.0, 600, 1)], [(None, 8.0, 20, 1)], [(None, 9.0, 20, 1), (None, 1.0, 700, 1)])):
        for m, own in enumerate((rows + more, [r for r in rows + more if (r[2] or 300) >= 200])):
            path = str(tmp_path / f"{n}{m}")
            spark.createDataFrame(own, "l_partkey long, l_quantity double, l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
            with duckdb.connect() as c:
                c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
                want = c.execute(assessments.ORACLE_SQL["store_first"]).fetchall()
            key = lambda r: tuple((x is None, x) for x in r)
            assert sorted(map(tuple, assessments.store_first(spark, path).collect()), key=key) == sorted(want, key=key), (n, m)


def test_nearest_folder_once(spark):
    """A document is looked up among folders, not among all the models that a folder holds."""
    docs = spark.createDataFrame([(f"a/b/x{i}.md", ["VERIFY_FORMAL"]) for i in range(50)] + [("y.md", ["VERIFY_FORMAL"])], "path string, tags array<string>")
    models = spark.createDataFrame([(f"a/formal/m{i}.py", []) for i in range(60)] + [("formal/r.py", []), ("a/b/formal/_m.py", [])], "model string, backs array<string>")
    found = [tuple(r) for r in formal.nearest(docs, models).collect()]
    assert sorted(found) == sorted([(f"a/b/x{i}.md", "a/formal") for i in range(50)] + [("y.md", "formal")])
    assert [r.path for r in formal.missing_models(docs, models).collect()] == ["y.md"]
    assert formal.backing(docs, models).count() == 50 * 60 + 1
