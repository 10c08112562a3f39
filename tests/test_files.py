"""Choosing, listing and reading files, the models among them, and the command line over them."""

import fnmatch
import pathlib
import random

from pyspark.sql import functions as F

from lintweave import cli
from lintweave.operators import formal
from lintweave.sources import files

TREE = {
    "a.md": b"# A\nTEST-AB-01", "docs/b.md": b"# B", "docs/b/c d.md": "# ü\n".encode(), "docs/b/bad.md": b"# \xff\xfe", "docs/x.txt": b"x", "docs/b/formal/m.py": b"BACKS = [\n 'docs/b.md', \"a.md\"]\nBACKS = ['no']",
    "docs/b/formal/_m.py": b"BACKS = ['docs/x.md']", "formal/top.py": b"", "docs/100%/é+.md": b"", "docs/in formal/x.py": b"BACKS=['q']", "docs/b/formal/deep/n.py": b"",
}


def tree(root):
    for p, content in TREE.items():
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    return str(root)


def test_read_files(spark, tmp_path):
    root = tree(tmp_path / "r.1 (x)")
    seen = {p for p in TREE if not p.split("/")[-1].startswith("_")}
    assert {(r.path, r.size) for r in files.list_files(spark, root).collect()} == {(p, len(TREE[p])) for p in seen}
    got = {r.path: r.content for r in files.read_files(spark, root, ["**/*.md", "docs/**/*.md", "*.md", "formal/*"]).collect()}
    want = {p: None if b"\xff" in TREE[p] else TREE[p].decode() for p in seen if p.endswith(".md")} | {"formal/top.py": ""}
    assert got == want
    only = files.read_files(spark, root, ["**/*.md"], ["docs/b/*"], ["^a"], ["a.md", "docs/b.md", "docs/b/bad.md", "none"])
    assert [r.path for r in only.collect()] == ["docs/b.md"]
    assert files.read_files(spark, root, []).count() == 0 and files.read_files(spark, root, ["*.none"]).count() == 0


def test_chosen_files_alone_are_read(spark, tmp_path):
    """The filter is on the scan: files that it leaves out aren't among those that the scan takes."""
    root = tree(tmp_path)
    frame = files.read_files(spark, root, ["docs/*.md", "formal/*.py"])
    assert frame.count() == 2
    plan = files._scan(spark, root, ["docs/*.md"], (), (), None)[0].select("_at", "content")
    plan.collect()
    leaf = plan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numFiles").value() == 1


def test_exclusions(spark):
    """As fnmatch on the whole path or on the name, for patterns of letters, *, ** and ?."""
    rng = random.Random(5)
    paths = sorted({"/".join("".join(rng.choice("ab.") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    rows = spark.createDataFrame([(p,) for p in paths], "path string").cache()
    for _ in range(25):
        glob = "".join(rng.choice(["a", "b", ".", "/", "*", "?"]) for _ in range(rng.randrange(1, 6))).replace("**/", "*a/")
        got = {r.path for r in rows.filter(files.chosen(F.col("path"), ["**"], [glob])).collect()}
        # ? doesn't cross folders here
        want = {p for p in paths if not any(fnmatch.fnmatchcase(x, glob) and ("?" not in glob or files.re.match(files.glob_regex(files.re.sub(r"\*+", "**", glob)), x)) for x in (p, p.split("/")[-1]))}
        assert got == want, glob


def test_models(spark, tmp_path):
    root = tree(tmp_path)
    models = formal.scripts(files.read_files(spark, root, ["**/*.py"])).cache()
    assert sorted(map(tuple, models.collect())) == [("docs/b/formal/m.py", ["docs/b.md", "a.md"]), ("formal/top.py", [])]
    docs = spark.createDataFrame([(p, ["VERIFY_FORMAL"]) for p in ("a.md", "docs/b.md", "docs/x.md", "docs/b/deep/y.md", "z.md")] + [("untagged.md", []), ("null.md", None)], "path string, tags array<string>")
    assert sorted(r.path for r in formal.missing_models(docs, models).collect()) == ["docs/x.md", "z.md"]
    assert formal.missing_models(docs, models.limit(0)).count() == 5
    assert formal.scripts(spark.createDataFrame([("formal/a.py", None)], "path string, content string")).first().backs == []


def test_command_line(spark, tmp_path, capsys):
    root = tree(tmp_path)
    pathlib.Path(root, "a.md").write_text("# A\n## 2 Tests\n| TEST-AB-01 |\n{VERIFY_FORMAL}\n")
    pathlib.Path(root, "docs/b.md").write_text("# B\nTEST-AB-01 and TEST-AB-02\n{VERIFY_FORMAL}\n")
    pathlib.Path(root, "docs/b/formal/m.py").write_text("BACKS = ['a.md']")
    cli.main(["check-doc", root, "--file", "docs/b.md", "--file", "docs/b/bad.md", "--exclude-pattern", "100"], spark)
    out = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    of = lambda rule: sorted((x[2], x[5]) for x in out if x[4] == rule)
    # the definition in a.md counts, although a.md isn't checked
    assert of("ID-UNRESOLVED-REFERENCE") == [("docs/b.md", "TEST-AB-02")]
    assert of("SRC-NOT-UTF8") == [("docs/b/bad.md", "Not UTF-8, 4 bytes")] and of("FORMAL-MODEL-NOT-FOUND") == [("docs/b.md", "VERIFY_FORMAL without a model")]
    cli.main(["next-id", root, "--id-glob", "docs/*.md"], spark)
    assert capsys.readouterr().out == ""
    cli.main(["next-id", root, "--id-glob", "*.md", "--id-glob", "docs/*.md"], spark)
    assert capsys.readouterr().out.split() == ["TEST", "AB", "02"]
