"""Passages that documents contain: by one scan, or by a join of runs where an automaton can't hold them all."""

from lintweave.plans import consistency


def test_one_scan_or_a_join(spark, tmp_path, monkeypatch):
    docs = [(1, "one two three four five six"), (2, None), (3, ""), (4, "zero\none two  three four five"), (5, "two three and one two three four five"), (6, "xone two three four fives")]
    rules = [(10, "one two three four five"), (11, "two three"), (12, None), (13, "one two three four five"), (14, "nowhere in any of them")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rules, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((d, i) for d, t in docs for i, p in rules if t is not None and p is not None and p in t)
    found = consistency.stale_value(spark, str(tmp_path))
    # no run of words is shuffled
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["doc_id", "item_id"] and sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(consistency, "AUTOMATON", 2)
    assert sorted(map(tuple, consistency.stale_value(spark, str(tmp_path)).collect())) == want
