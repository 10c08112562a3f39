from lintweave.operators import gates, markdown

TIERS = [("^docs/req/", "0"), ("^docs/design/", "1"), ("^docs/parts/", "2")]
FILES = [
    ("req/a.md", "# Goal\n<!-- definition: {REQ_A} -->\n{REQ_A} holds. See [x.md](parts/x.md) and [gone.md](design/gone.md).\n## Other\n<!-- definition: {REQ_B} -->\nno marker\n"),
    ("design/d.md", "intro\n# Design\n<!-- traceability: {REQ_A} {PART_X} -->\n[a.md](req/a.md#nowhere) [a.md](req/a.md#goal)\n{UNKNOWN}\n```\n{IN_FENCE}\n# not a heading\n```\n{VERIFY_WIT}\n"),
    ("parts/x.md", "# Part\n<!-- definition: {PART_X} -->\n{PART_X}\n```mermaid\n```\n<!-- evidence:\n wit: w/x.wit\n-->\n<!-- definition: {REQ_A} -->\n{REQ_A}\n"),
    ("plain.md", None),
]


def corpus(spark):
    return gates.Corpus(spark.createDataFrame(FILES, "path string, content string"), TIERS)


def test_sections(spark):
    got = {(r.path, r.heading, r.level, r.line_start, r.line_end) for r in corpus(spark).sections.collect()}
    assert got == {("req/a.md", "Goal", 1, 1, 3), ("req/a.md", "Other", 2, 4, 6), ("design/d.md", "(Overview)", 1, 1, 1), ("design/d.md", "Design", 1, 2, 10), ("parts/x.md", "Part", 1, 1, 10), ("plain.md", "", 0, 1, 1)}


def test_checks(spark):
    got = {(r.rule_code, r.path, r.line) for r in gates.run_checks(corpus(spark)).collect()}
    assert got == {
        ("FMT-BROKEN-LINK", "req/a.md", 3), ("FMT-BROKEN-ANCHOR", "design/d.md", 4), ("FMT-EMPTY-MERMAID", "parts/x.md", 4),
        ("TRACE-UNDEFINED-KEYWORD", "design/d.md", 2), ("TRACE-UNREFERENCED-REQUIREMENT", "req/a.md", 1),
        ("TRACE-DEFINITION-WITHOUT-INLINE-MARKER", "req/a.md", 4), ("CONSIST-DUPLICATE-DEFINITION", "req/a.md", 1),
        ("HIERARCHY-REVERSE-DEPENDENCY", "req/a.md", 3), ("HIERARCHY-REVERSE-KEYWORD-REF", "design/d.md", 2),
        ("EVID-WIT-UNDECLARED", "design/d.md", 1), ("EVID-DECLARED-FILE-MISSING", "parts/x.md", 1),
    }


def test_own_check_and_summary(spark):
    c = corpus(spark)
    issues = gates.run_checks(c, ["own"], {"own": lambda c: gates.stale_values(c, [("R1", "no marker", "old")])})
    assert [(r.path, r.line) for r in issues.collect()] == [("req/a.md", 6)]
    assert gates.summary(issues).first().exit_code == 1


def test_evidence_keeps_last(spark):
    files = spark.createDataFrame([("a.md", "<!-- evidence:\n# no\nWit: 'x'\nwit: y\nformal=m.py benchmark=b.py\n-->")], "path string, content string")
    assert {(r.key, r.value) for r in markdown.evidence(files).collect()} == {("wit", "y"), ("formal", "m.py"), ("benchmark", "b.py")}


def test_cut_in_rows(spark):
    """Lines, sections and keywords of whole files against the windows over lines."""
    import random

    from lintweave.operators import lines, markdown

    rng = random.Random(3)
    pool = ["# A", "## B {K_1}", "#none", "```", "  ```text", "", "{K_2} <!-- definition: {K_2} -->", "<!-- traceability: {K_3}", "{K_4} -->", "<!-- definition: {K_5} -->", "text\r", "### C", "#### D", "~~~", " ```"]
    texts = [None, "", "\n", "```", "\n```\n\n", "# A\n", "x\n# A"] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")
    trimmed = files.select("path", gates.F.regexp_replace(gates.F.coalesce("content", gates.F.lit("")), r"\r?\n\z", "").alias("content"))
    slow = lines.parity(lines.lines_of(trimmed, "content").drop("content"), gates.F.col("line").rlike(r"(?U)^\s*```"), ["path"], "line_no")
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert rows(markdown.lines(files)) == rows(slow)
    c = gates.Corpus(files, [])
    assert rows(c.sections) == rows(markdown.sections(slow))
    assert rows(c.keywords) == rows(markdown.keywords(slow, markdown.sections(slow)))
    assert rows(c.named("defined", "traced")) == rows(c.keywords.filter("kind IN ('defined', 'traced')"))
