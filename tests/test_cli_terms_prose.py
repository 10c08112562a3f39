from lintweave import cli
from lintweave.operators import prose, termmine


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "req").mkdir()
    (tmp_path / "req/a.md").write_text("# Goal  \n<!-- definition: {REQ_A} -->\n{REQ_A} [b.md](b.md) TEST-AA-01\n\n\n")
    (tmp_path / "b.md").write_text("# B\n<!-- traceability: {REQ_A} -->\n{REQ_A}\n## 2. Tests\n| TEST-AA-01 |\n")
    (tmp_path / "x.py").write_text("def f(): ...\n")
    run = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)
    assert run("check-doc", str(tmp_path), "--tier", "^docs/req/=0") == (0, "")
    (tmp_path / "c.md").write_text("[gone.md](gone.md)\n")
    code, out = run("check-doc", str(tmp_path))
    assert code == 1 and "FMT-BROKEN-LINK\tLink target is missing: gone.md" in out
    assert run("check-doc", str(tmp_path), "--exclude", "**/c.md")[0] == 0
    (tmp_path / "c.md").write_text("[b.md](b.md) RATE_A = 0x10, RATE_B = 3 and counter conntes\n\nRATE_A = 17, see lost.py, counter countes\n")
    code, out = run("check-doc", str(tmp_path), "--symbol", "RATE_[A-Z]", "--stale", "RATE_B")
    assert code == 1 and "RATE_A has several values: 16 @ c.md:1; 17 @ c.md:3" in out and "Missing: lost.py" in out and "S1: RATE_B" in out
    assert "FMT-LEVENSHTEIN-TYPO\tMay be a variant: countes and counter (c.md:1)" in out
    code, out = run("report", str(tmp_path), "--symbol", "RATE_[A-Z]")
    assert code == 0 and "| Consistency | 1 | 0 | FAIL |" in out and "| Evidence | EVID-DANGLING-ARTIFACT-REF" not in out and "| Evidence | ERROR | EVID-DANGLING-ARTIFACT-REF | 1 |" in out
    (tmp_path / "c.md").unlink()
    assert run("next-id", str(tmp_path))[1] == "TEST\tAA\t02\n"
    drawn = run("graph", str(tmp_path))[1]
    number = lambda label: next(x.split("[")[0].strip() for x in drawn.splitlines() if x.endswith(f'"{label}"]'))
    assert f"{number('Sec: Goal')} ==> {number('Item: REQ_A')}" in drawn
    assert '{"source":"sec:req/a.md#Goal","target":"item:REQ_A","relation":"defines"}' in run("graph-json", str(tmp_path))[1]
    assert run("check-src", str(tmp_path))[0] == 1
    assert run("format-doc", str(tmp_path))[1] == "req/a.md\n" and (tmp_path / "req/a.md").read_text().startswith("# Goal\n")
    assert "REQ_A\t" in run("build", str(tmp_path))[1]


def test_terms(spark):
    sections = spark.createDataFrame([("a", 1, "# Heading words\nデータ処理 the {REQ_ONE} `code` [label](target)"), ("b", 1, "words words 仕様書"), ("c", 1, None)], "path string, section int, body string")
    found = termmine.candidates(sections)
    rows = {r.term: r for r in termmine.scored(found, 3).collect()}
    assert set(rows) == {"Heading", "words", "データ", "データ処理", "処理", "REQ_ONE", "label", "仕様書"}
    assert (rows["words"].df, rows["words"].total, rows["データ"].kind) == (2, 3, "katakana")
    snippets = {(r.term, r.path): r.snippet for r in termmine.occurrences(found, sections, 5).collect()}
    assert snippets["words", "b"] == "words word" and snippets["label", "a"] == "de` [label](tar"


def test_prose(spark):
    text = "---\ntitle: 題\n---\n# 見出し\n一文目です。二文目\nは続きます。\n\n````\n```\n中のコード\n````\n<!-- 注\n釈 --> 本文\n| 表 | cell |\n|---|---|\n- 項目\n> 引用\nplain english\n"
    assert prose.blocks(text) == [(5, "一文目です。二文目 は続きます。"), (13, "本文"), (14, "表"), (16, "項目"), (17, "引用 plain english")]
    files = spark.createDataFrame([("a.md", text), ("b.md", None)], "path string, content string")
    assert [(r.line, r.sentence, r.n_chars) for r in prose.candidates(files, 7).collect()] == [(5, "二文目 は続きます。", 9), (17, "引用 plain english", 14)]
