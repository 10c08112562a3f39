from lintweave.operators import obligation


def tables(spark):
    docs = spark.createDataFrame([("a", "h1", ["VERIFY_LLM"]), ("b", "h2", []), ("c", "h3", ["VERIFY_LLM"])], "path string, content_hash string, tags array<string>")
    risks = spark.createDataFrame([("K1", "b", 5, ["b"]), ("K2", "a", 4, ["a", "b"]), ("K3", "b", 2, ["b"])], "item_id string, path string, risk int, covered array<string>")
    runs = spark.createDataFrame([("risk", "mock")], "run_type string, backend string")
    assessed = spark.createDataFrame([("risk", "a", "h1"), ("risk", "b", "old"), ("doc", "a", "h1"), ("doc", "c", "old")], "run_type string, path string, content_hash string")
    results = spark.createDataFrame([("doc", "x", "FAIL", ["a"])], "run_type string, item_id string, status string, covered array<string>")
    keys = spark.createDataFrame([("K1",), ("K9",)], "keyword string")
    return docs, risks, runs, assessed, results, keys


def got(df):
    return {(r.rule_code, r.path) for r in df.collect()}


def test_assessments(spark):
    docs, risks, runs, assessed, _, keys = tables(spark)
    assert got(obligation.assessment_checks(docs, risks, runs, assessed, keys)) == {
        ("OBLIG-ASSESSMENT-NOT-INDEPENDENT", None), ("OBLIG-ASSESSMENT-STALE", "b"), ("OBLIG-ASSESSMENT-PARTIAL", None), ("OBLIG-VERIFICATION-SKIPPED", "b"),
    }
    assert got(obligation.assessment_checks(docs, risks.limit(0), runs, assessed.limit(0), keys)) == {("OBLIG-ASSESSMENT-MISSING", None)}
    assert ("OBLIG-PROVENANCE-UNKNOWN", None) in got(obligation.assessment_checks(docs, risks, runs.limit(0), assessed, keys))
    assert tuple(obligation.coverage(docs, risks).first()) == (2, 1, 0.5)
    assert tuple(obligation.coverage(docs, risks.limit(0)).first()) == (0, 0, 1.0)


def test_judgements(spark):
    docs, _, _, assessed, results, _ = tables(spark)
    assert got(obligation.judgement_checks(docs, results, assessed, "doc")) == {("OBLIG-JUDGE-STALE", "c"), ("OBLIG-JUDGE-SKIPPED", "c"), ("OBLIG-JUDGE-FAILED", "a")}
    assert got(obligation.judgement_checks(docs, results.limit(0), assessed, "doc")) == {("OBLIG-JUDGE-MISSING", None)}
    assert got(obligation.judgement_checks(docs, results, assessed.limit(0), "doc")) == {("OBLIG-JUDGE-UNANCHORED", None)}
