import pytest
from pyspark.sql import functions as F

from lintweave.operators import code_rules, review, wit

CODE = '''import low.part
from typing import Any, Union, overload, Protocol
def f(a: Any, b: object, c: int | str, d: "int | None") -> int:
    assert a.pop()
    x = a or 3
    return getattr(a, "b")
def empty(): ...
class P(Protocol):
    def quiet(self): ...
def reset_for_test(a):  # TODO later
    raise ValueError
def rich(x):
    return isinstance(x, int) and x or [y for y in x if y]
s = "TODO"
'''


def test_python_rules(spark):
    files = spark.createDataFrame([("top/a.py", CODE), ("b.py", "def ("), ("c.py", None), ("d.txt", "TODO")], "path string, content string")
    got = {(r.path, r.line, r.rule) for r in code_rules.python_rules(files).collect()}
    assert got == {
        ("top/a.py", 3, "PY-FORBIDDEN-TYPING-ANY"), ("top/a.py", 3, "PY-FORBIDDEN-OBJECT-TYPE"), ("top/a.py", 3, "PY-FORBIDDEN-NON-NONE-UNION"),
        ("top/a.py", 4, "PY-ASSERT-SIDE-EFFECT"), ("top/a.py", 5, "PY-FORBIDDEN-NONE-DEFAULT-FILL"), ("top/a.py", 6, "PY-FORBIDDEN-STRING-MEMBER"), ("top/a.py", 7, "SABOTAGE-EMPTY-FUNCTION"),
        ("top/a.py", 10, "SABOTAGE-TODO-COMMENT"), ("top/a.py", 10, "PY-TEST-CODE-IN-PRODUCT"), ("top/a.py", 11, "PY-FORBIDDEN-RAISE"), ("top/a.py", 13, "PY-FORBIDDEN-RTTI"), ("b.py", 1, "PY-SYNTAX-ERROR"),
    }  # a quoted annotation isn't taken apart: no PY-REQUIRED-ARGUMENT-NULLABLE in line 3
    tiers = spark.createDataFrame([("top", 0), ("low", 2), ("low.part", 1)], "module string, tier int")
    assert [(r.path, r.line) for r in code_rules.import_direction(code_rules.imports(files), tiers).collect()] == [("top/a.py", 1)]


def test_complexity(spark):
    files = spark.createDataFrame([("a.py", CODE)], "path string, content string")
    ccn = {r.function: r.ccn for r in code_rules.functions(files).collect()}
    assert ccn["rich"] == 4 and ccn["empty"] == 1
    measured = spark.createDataFrame([("a", "f", 12), ("a", "g", 15), ("a", "h", 3)], "path string, function string, ccn int")
    allowed = spark.createDataFrame([("a", "g", 14), ("a", "h", 12), ("a", "gone", 11)], "path string, function string, baseline int")
    got = {(r.function, r.rule) for r in code_rules.complexity_issues(measured, allowed, 10).collect()}
    assert got == {("f", "SRC-COMPLEXITY"), ("g", "SRC-COMPLEXITY-RATCHET"), ("h", "SRC-COMPLEXITY-ALLOWLIST-STALE"), ("gone", "SRC-COMPLEXITY-ALLOWLIST-STALE")}


def test_cpp(spark):
    files = spark.createDataFrame([("a.cpp", 'x = malloc(3);\n// throw\nint f() {}\ny = new T;\ns = "try";\nnamespace own {')], "path string, content string")
    assert {(r.line, r.rule) for r in code_rules.cpp_rules(files, "own").collect()} == {(1, "CPP-FORBIDDEN-MALLOC"), (3, "SABOTAGE-EMPTY-FUNCTION"), (4, "CPP-FORBIDDEN-NEW")}
    assert {r.rule for r in code_rules.cpp_rules(files.filter("true").withColumn("content", F.lit("x")), "own").collect()} == {"CPP-MISSING-NAMESPACE"}


def test_wit(spark):
    files = spark.createDataFrame([("a.wit", "package a:b;\ninterface one {\n f: func() -> list<u8>;\n}\nworld w { }"), ("b.wit", "interface x {\n // }\n"), ("c.wit", None)], "path string, content string")
    got = {r.path: (r.status, r.line, r.interfaces, r.worlds) for r in wit.check(files).collect()}
    assert got == {"a.wit": ("PASS", None, ["one"], ["w"]), "b.wit": ("FAIL", 1, ["x"], []), "c.wit": ("FAIL", 1, [], [])}


def test_review(spark):
    items = spark.createDataFrame([("s1", "section", "x" * 50), ("s2", "section", "y"), ("p", "pair", "z")], "item_id string, mode string, body string")
    checks = spark.createDataFrame([("c1", "section", True), ("c2", "section", True), ("c3", "section", True), ("c4", "section", False)], "check_id string, mode string, enabled boolean")
    asked = review.requests(items, checks, 2, 20)
    assert {(r.item_id, r.batch, tuple(r.check_ids)) for r in asked.collect()} == {(s, b, c) for s in ("s1", "s2") for b, c in ((0, ("c1", "c2")), (1, ("c3",)))}
    assert {r.status for r in review.status(review.ask(asked)).collect()} == {"PASS"}
    strict = lambda rs: [{"outcome": "fail" if r["item_id"] == "s1" else "skipped", "severity": "major", "score": 0.9} for r in rs]
    assert {r.item_id: r.status for r in review.status(review.ask(asked, strict)).collect()} == {"s1": "FAIL", "s2": "SKIPPED"}
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (4.0,)], "s double").select(review.risk(F.col("s"))).collect()] == [1, 3, 5]
    with pytest.raises(Exception, match="0 to 4"):
        spark.createDataFrame([(5.0,)], "s double").select(review.risk(F.col("s"))).collect()
    rows = spark.createDataFrame([("k", i) for i in range(10)] + [("m", 1)], "k string, i int")
    assert sorted((r.k, r.i) for r in review.sampled(rows, "k", "i").collect()) == [("k", 0), ("k", 3), ("k", 6), ("k", 9), ("m", 1)]
