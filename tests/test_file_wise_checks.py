"""Checks that cut files where their rows are: as their line-wise forms, without windows over lines."""

from pyspark.sql import functions as F

from lintweave.operators import blocks, evidence, gates, markdown, typos

FILES = [
    ("docs/a.md", "# One\nThe reader reads readers, reades and readed words of reader1 and reader2.\n~~~\nhidden.py gone.py\n```\nreaden hiddens\n```\n~~~\nSee ./b.md, ../x/c.py.txt, `code.md` and *.md.\n## Two\nコンピュータ and コンピューター words wordy"),
    ("docs/b.md", "lead line wordz wordy\n　```\nin a fence: lost.py [l.py](lost.py)\n```\n[c.md](sub/c%20d.md) [`m.py`](m.py) m.py m.py https://x.org/u.py\n# Head\nReader READER reader_x Readers readerz `readerq`\n[c.md](b.md#x) c.md\n- no.such.json<x.md x.mdx"),
    ("sub/c d.md", None),
    ("m.py", ""),
    ("e.md", "コンピュータ コンピュータ\n```\nコンピューター\n"),
]


def _old_dangling(c):
    each = evidence.references(c.lines).filter(~F.startswith("ref", F.lit("http")))
    label = F.trim(F.regexp_replace("label", "^ *`?|`? *$", ""))
    targets = markdown.links(c.lines).filter("target <> ''").groupBy("path", "line_no", label.alias("ref")).agg(F.min("target").alias("target"))
    named = each.join(targets, ["path", "line_no", "ref"], "left").withColumn("target", F.coalesce(F.trim("target"), F.col("ref")))
    at = named.select("path", "line_no", "ref", F.explode(F.concat(evidence._candidates("ref"), evidence._candidates("target"))).alias("at"))
    held = at.join(c.paths.select(F.col("path").alias("at")), "at").select("path", "line_no", "ref")
    bare = named.join(c.paths.select(F.substring_index("path", "/", -1).alias("ref")), "ref").select("path", "line_no", "ref")
    return named.select("path", "line_no", "ref").join(held.unionByName(bare), ["path", "line_no", "ref"], "left_anti").collect()


def test_dangling(spark):
    c = gates.Corpus(spark.createDataFrame(FILES, "path string, content string"), [], spark.createDataFrame([("x/gone.json",)], "path string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(c.prose.select("path", "line_no", "line")) == rows(markdown.prose(c.lines))
    found = evidence.dangling_artifacts(c)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.path, r.line, r.message.removeprefix("Missing: ")) for r in found.collect()]
    assert got and sorted(got) == sorted(map(tuple, _old_dangling(c)))


def test_variants(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    for c in (gates.Corpus(files, []), blocks.Corpus(files, [])):
        placed = markdown.with_section(c.lines.select("path", "line_no", "line", "inside", "is_fence"), c.sections)
        for pattern, pairs, made in ((typos.KATAKANA, typos.katakana_variants, typos.katakana_found), (typos.ENGLISH, typos.english_variants, typos.english_found)):
            words = typos.words_of(placed, pattern)
            want = typos.variants(words, typos.first_variants(pairs(words))).collect()
            assert want and sorted(made(c.bodies()).collect()) == sorted(want)
    # sections come from the file's row
    assert "Window" not in gates.typo_variants(gates.Corpus(files, []))._jdf.queryExecution().optimizedPlan().toString()


def test_variants_of_lines(spark, tmp_path, monkeypatch):
    """The queries on documents compare a line's words where its row is: occurrences are neither shuffled nor sorted."""
    from lintweave.plans import assessments

    monkeypatch.setattr(typos, "HELD", 3)
    text = "The reader reads readers, reades and readed words of reader1, reader2\nwordx wordy `wordz` wordx\n\nReaderz readerx readery reader_z WORDX Wordx"
    rows = [(i, None if i == 5 else text.replace("wordx", f"word{i % 3}")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = typos.words_of(lines.select(F.col("doc_id").alias("path"), (F.col("n") + 1).alias("line_start"), "line", F.lit(False).alias("inside"), F.lit(False).alias("is_fence")), typos.ENGLISH)
    pairs = typos.english_variants(words)
    got = assessments.typo_variants(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() > 3
    want = typos.variants(words, typos.first_variants(pairs)).drop("word", "other")
    places = assessments.typo_places(spark, str(tmp_path))
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, want.collect()))
    for found in (got, places):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(path" not in plan and ("SortAggregate" not in plan or found is places)


def test_graph_edges(spark):
    """Edges come from the files' rows, without windows over lines; the same as from lines, sections and keywords."""
    from lintweave.cli import graph_edges

    more = [
        ("docs/g.md", "lead [a](a.md) ![no](b.md) [x](https://x.org/a.md) [a](#one)\n# One\n{K_1} <!-- definition: {K_1} -->\n[b](b.md#x) [bb](docs/b.md) [c](../sub/c%20d.md) [m](mailto:x)\n# One\n<!-- traceability: {K_2},\n{K_1} -->\n[b](b.md) [](b.md) [l](lost.md)\n```\n[b](a.md)\n```"),
        ("docs/g.md#One", "# Two\n[g](g.md)"),
    ]
    for rows in (FILES + more[:1], FILES + more + more[:1]):
        c = gates.Corpus(spark.createDataFrame(rows, "path string, content string"), [])
        got = graph_edges(c)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        other = gates.Corpus(c.files, [])
        other.sections  # noqa: B018 - known sections take the way over lines
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph_edges(other).collect()))
