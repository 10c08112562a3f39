"""Line states against loops, whatever the length of pieces."""

import random

import pytest

from lintweave.operators import gates, states


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_run(spark, piece):
    rng = random.Random(piece)
    table = [[rng.randrange(5) for _ in range(5)] for _ in range(6)]
    files = {f"f{i}": [rng.randrange(6) for _ in range(rng.randrange(1, 40))] for i in range(30)}
    rows = spark.createDataFrame([(p, n, c) for p, own in files.items() for n, c in enumerate(own, 1)], "path string, line_no int, c int").repartition(3)
    got = {(r.path, r.line_no): r.state for r in states.run(rows, states.F.col("c"), table, piece, start=2).collect()}
    want = {}
    for p, own in files.items():
        s = 2
        for n, c in enumerate(own, 1):
            want[p, n] = s
            s = table[c][s]
    assert got == want


def by_hand(text):
    """Prose lines, by two flags."""
    code = comment = False
    out = set()
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith("```"):
            code = not code
        elif code:
            pass
        elif comment:
            comment = "-->" not in line
        elif bare.startswith("<!--"):
            comment = "-->" not in bare
        elif not bare.startswith("---"):
            out.add(n)
    return out


def test_visible(spark):
    rng = random.Random(2)
    pool = ["text", "```", " ```py", "~~~", "<!-- a", "<!-- a --> b", "b --> c", "-->", "---", "", "　<!-- wide", "a <!-- b"]
    files = {f"f{i}": "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for i in range(200)}
    rows = [(p, n, line) for p, t in files.items() for n, line in enumerate(t.split("\n"), 1)]
    got = {(r.path, r.line_no) for r in states.visible(spark.createDataFrame(rows, "path string, line_no int, line string")).collect()}
    assert got == {(p, n) for p, t in files.items() for n in by_hand(t)}


@pytest.mark.parametrize(
    ("line", "found"),
    [
        ("see src/a.py and src/a.py.", ["src/a.py", "src/a.py"]), ("[a.py](src/a.py) <a href='src/a.py'>", []), ("(src/a.py) [src/a.py]", []), ("x/src/a.py ./src/a.py", []), ("src/a.pyを", []), ("を src/a.py、", ["src/a.py"]),
        ("src/none.py", []), ("docs/d.md d.md src/", ["docs/d.md"]), ("-src/a.py asrc/a.py src/a.py/x", ["src/a.py", "src/a.py"]), ("src/a.py-old", ["src/a.py"]),
    ],
)
def test_bare_paths(spark, line, found):
    c = gates.Corpus(spark.createDataFrame([("d.md", line), ("empty.md", None)], "path string, content string"), [], spark.createDataFrame([("src/a.py",)], "path string"))
    assert sorted(r.message for r in states.bare_paths(c).collect()) == [f"{x}: a path without a link" for x in found]


@pytest.mark.parametrize("query", ["shape_bare_paths", "shape_underlined", "shape_labels", "shape_broken_labels"])
def test_no_lines_are_broadcast(spark, query):
    from lintweave.plans import shapes

    # the planner takes lines for as few bytes as the orders that they are made of
    plan = shapes.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
