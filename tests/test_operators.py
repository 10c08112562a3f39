import math

import pytest
from pyspark.sql import functions as F

from lintweave.functions.text import anchor_slug, collapsed_path, value_text
from lintweave.operators import drift, markdown
from lintweave.operators.gates import Corpus
from lintweave.operators.ranges import expand_ranges
from lintweave.operators.reach import reachable
from lintweave.operators.typos import spelling_pairs, suffix_pairs
from lintweave.operators.vectors import cosine_pairs


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("0x0", "0"), ("0XffUL", "255"), ("0x_10_00", "4096"), ("12", "12"), ("012", "12"), ("3l", "3"), ("7.0", "7"), ("7.250", "7.250"), ("1 mb", "1048576"), ("0.5 KB", "512"),
        ("2バイト", "2"), ("8 bit", "8bit"), ("2.50 ms", "2.5ms"), ("40 US", "40us"), ("9 B", "9"), ("name", "name"), ("full", "f"), (" 1\u30002 ", "12"),
    ],
)
def test_values(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(value_text(F.col("t"))).first()[0] == value


def test_values_of_symbols(spark):
    """Assignment before default before a table row with one value; several values of a symbol with their places."""
    text = "\n".join([
        "LIMIT_A := 0x20, default: 7", "LIMIT_A stands for 5; default = 33 B", "| LIMIT_A | 32 | words |", "| LIMIT_A | 32 | 33 |", "| words | LIMIT_A | 34 |", "LIMIT_A is big",
        "```", "LIMIT_A = 99", "```", "| `LIMIT_B` | `1 KB` |", "LIMIT_B = 1024 and LIMIT_A = 32",
    ])
    files = spark.createDataFrame([("a.md", text), ("b.md", "LIMIT_B = 1_024U")], "path string, content string")
    found = {(r.path, r.line_no, r.symbol, r.value) for r in drift.symbol_values(markdown.lines(files), ["LIMIT_[A-Z]"]).collect()}
    assert found == {("a.md", 1, "LIMIT_A", "32"), ("a.md", 2, "LIMIT_A", "33"), ("a.md", 3, "LIMIT_A", "32"), ("a.md", 10, "LIMIT_B", "1024"), ("a.md", 11, "LIMIT_B", "1024"), ("a.md", 11, "LIMIT_A", "32"), ("b.md", 1, "LIMIT_B", "1024")}
    more = spark.createDataFrame([("c.h", "LIMIT_B = 5"), ("b.md", "LIMIT_B = 6")], "path string, content string")
    issues = drift.symbol_drift(Corpus(files, []), ["LIMIT_[A-Z]"], more).collect()
    assert {(r.path, r.line, r.message) for r in issues} == {
        ("a.md", 1, "LIMIT_A has several values: 32 @ a.md:1, a.md:11, a.md:3; 33 @ a.md:2"), ("a.md", 10, "LIMIT_B has several values: 1024 @ a.md:10, a.md:11, b.md:1; 5 @ c.h:1"),
    }


def test_text_functions(spark):
    row = spark.createDataFrame([("./a\\b", " A b, Ünï! ")], "p string, h string").select(collapsed_path(F.col("p")), anchor_slug(F.col("h"))).first()
    assert tuple(row) == ("a/b", "a-b-ünï")


def test_ranges(spark):
    ranges = spark.createDataFrame([("a", 3, 9), ("b", 9, 3), ("c", 5, 5)], "k string, low long, high long")
    points = spark.createDataFrame([(i,) for i in (1, 3, 5, 9, 10)], "serial long")
    assert sorted((r.k, r.serial) for r in expand_ranges(ranges, points, 4).collect()) == [("a", 3), ("a", 5), ("a", 9), ("c", 5)]


def test_reach_with_a_cycle(spark):
    start = spark.createDataFrame([("m", "a")], "model string, state string")
    edges = spark.createDataFrame([("m", "a", "b"), ("m", "b", "a"), ("m", "b", "c"), ("m", "x", "y"), ("n", "a", "z")], "model string, source string, target string")
    assert {r.state for r in reachable(start, edges).collect()} == {"a", "b", "c"}


def test_typos(spark):
    rows = spark.createDataFrame([(1, 1, w) for w in ("counter", "counters", "countes", "other")] + [(2, 1, "counted")], "doc_id long, line_no long, word string")
    assert {(r.word_a, r.word_b) for r in spelling_pairs(rows, ["doc_id", "line_no"], 6).collect()} == {("counter", "counters"), ("counter", "countes")}
    kata = spark.createDataFrame([("コンピュータ",), ("コンピューター",), ("サーバ",)], "word string")
    assert [(r.word_a, r.word_b) for r in suffix_pairs(kata, "ー", 6).collect()] == [("コンピュータ", "コンピューター")]


@pytest.mark.parametrize("block_rows", [2, 100])
def test_cosine(spark, block_rows):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "id long, vector array<double>")
    got = {(r.a, r.b): r.similarity for r in cosine_pairs(rows, 0.5, block_rows=block_rows).collect()}
    assert set(got) == {(1, 2), (2, 3), (1, 6), (2, 6)}
    assert math.isclose(got[1, 2], math.sqrt(0.5)) and math.isclose(got[1, 6], 1.0)


def test_files_are_cut_in_one_row(spark):
    """Odd files give what windows over their lines give, without a shuffle."""
    odd = [
        "", None, "\n", "\r\n", "# A {x}\r\n{y}\r\n", "a\n#  b\n# c\n#\td \n####### e\n## f g\n", "```\n# in {a}\n~~~\n 　```\n# out {b}\n## {VERIFY_X} {Decision_1}",
        "<!-- definition: {a}\n{b} --> {a}\n<!-- DEFINITION: {c} {c} -->\n<!-- defınition: {d} -->\n<!-- traceability: {e}\n```\n{f} -->\n```\n# g\n{h}", "## b\n# a\n### c\n## d\n#### e\n# f\n\n", "{a\n}```\n# x```\n",
    ]
    files = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(odd)], "path string, content string")
    rows = markdown.lines(files)
    found = markdown.sections(rows)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(markdown.atx_sections(files), found)
    assert same(markdown.atx_keywords(files), markdown.keywords(rows, found))
    assert same(markdown.atx_keywords(files, ("traced", "defined")), markdown.keywords(rows, found).filter("kind IN ('traced', 'defined')"))
    bare = files.select("path", F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\r?\n\z", ""), "\n")).alias("n", "line"))
    marked = markdown.parity(bare.withColumn("line_no", F.col("n") + 1), F.col("line").rlike(r"(?U)^[^\S\n]*```"), ["path"], "line_no")
    assert same(rows, marked)
    for made in (rows, markdown.atx_sections(files), markdown.atx_keywords(files)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
