"""The obligation ledger: whether documents that need an assessment have one that is independent, current and complete.

documents (path, content_hash, tags), assessments (item_id, path, risk, covered array of paths), runs (run_type, backend),
assessed (run_type, path, content_hash), results (run_type, item_id, status, covered). Each check is an issue relation
(severity, rule_code, path, message); a check on the whole ledger has a null path. What makes later checks pointless
(no results, no hashes) suppresses them by an anti-join on a constant key, not by a decision on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(spark) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("k"))


def _if_any(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """rows if gate has a row, else none."""
    return rows.withColumn("k", F.lit(1)).join(gate.limit(1).select(F.lit(1).alias("k")), "k", "left_semi").drop("k")


def _if_none(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """rows if gate has no row, else none."""
    return rows.withColumn("k", F.lit(1)).join(gate.limit(1).select(F.lit(1).alias("k")), "k", "left_anti").drop("k")


def _issues(rows: DataFrame, severity: str, rule: str, message: str, path: Column | None = None) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_code"), (F.lit(None).cast("string") if path is None else path).alias("path"), F.lit(message).alias("message"))


def stale(documents: DataFrame, assessed: DataFrame, run_type: str) -> DataFrame:
    """Documents whose hash differs from the one assessed in a run type."""
    then = assessed.filter(F.col("run_type") == run_type).select("path", F.col("content_hash").alias("then"))
    return documents.join(then, "path").filter(F.col("then") != F.col("content_hash")).select("path")


def assessment_checks(documents: DataFrame, assessments: DataFrame, runs: DataFrame, assessed: DataFrame, keywords: DataFrame, high: int = 4, dependent: tuple[str, ...] = ("mock",)) -> DataFrame:
    """Missing, unknown, dependent, stale and partial assessments, and high risks without a verification tag."""
    spark, risk_runs = documents.sparkSession, runs.filter("run_type = 'risk'")
    one = _one(spark)
    missing = _issues(_if_none(one, assessments), "WARNING", "OBLIG-ASSESSMENT-MISSING", "No assessment")
    unknown = _issues(_if_any(_if_none(one, risk_runs), assessments), "ERROR", "OBLIG-PROVENANCE-UNKNOWN", "No record of who assessed")
    own = _issues(_if_any(risk_runs.filter(F.col("backend").isin(*dependent)).select(F.lit(1).alias("k")), assessments), "ERROR", "OBLIG-ASSESSMENT-NOT-INDEPENDENT", "Assessed by what isn't independent")
    old = _issues(stale(documents, assessed, "risk"), "WARNING", "OBLIG-ASSESSMENT-STALE", "Changed since the assessment", F.col("path"))
    open_keys = keywords.select("keyword").distinct().join(assessments.select(F.col("item_id").alias("keyword")), "keyword", "left_anti")
    partial = _issues(_if_any(_if_any(one, open_keys), assessments), "WARNING", "OBLIG-ASSESSMENT-PARTIAL", "Not all keywords are assessed")
    tagged = documents.filter("exists(tags, t -> startswith(t, 'VERIFY_'))").select("path")
    risky = assessments.filter(F.col("risk") >= high)
    covered = risky.select("item_id", F.explode("covered").alias("path")).join(tagged, "path", "left_semi").select("item_id").distinct()
    skipped = _issues(risky.join(covered, "item_id", "left_anti"), "ERROR", "OBLIG-VERIFICATION-SKIPPED", "A high risk without verification", F.col("path"))
    return reduce(DataFrame.unionByName, (missing, unknown, own, old, partial, skipped))


def judgement_checks(documents: DataFrame, results: DataFrame, assessed: DataFrame, run_type: str, tag: str = "VERIFY_LLM", prefix: str = "OBLIG-JUDGE") -> DataFrame:
    """Missing, unanchored, stale, skipped and failed judgements of tagged documents; the first two suppress the others."""
    own, anchors = results.filter(F.col("run_type") == run_type), assessed.filter(F.col("run_type") == run_type)
    tagged = documents.filter(F.array_contains("tags", tag)).select("path", "content_hash")
    one = _if_any(_one(documents.sparkSession), tagged)
    missing = _issues(_if_none(one, own), "WARNING", f"{prefix}-MISSING", "No judgement")
    unanchored = _issues(_if_any(_if_none(one, anchors), own), "WARNING", f"{prefix}-UNANCHORED", "Judged without hashes")
    covered = own.select("status", F.explode("covered").alias("path"))
    rest = [
        _issues(stale(tagged, anchors, run_type), "WARNING", f"{prefix}-STALE", "Changed since the judgement", F.col("path")),
        _issues(tagged.join(covered, "path", "left_anti"), "WARNING", f"{prefix}-SKIPPED", "Not judged", F.col("path")),
        _issues(tagged.join(covered.filter("status = 'FAIL'"), "path", "left_semi"), "ERROR", f"{prefix}-FAILED", "Judged to fail", F.col("path")),
    ]
    return reduce(DataFrame.unionByName, [missing, unanchored, *(_if_any(_if_any(x, own), anchors) for x in rest)])


def coverage(documents: DataFrame, assessments: DataFrame, high: int = 4) -> DataFrame:
    """One row: demanded and discharged verifications and their share, 1 if none is demanded."""
    tagged = documents.filter("exists(tags, t -> startswith(t, 'VERIFY_'))").select("path")
    risky = assessments.filter(F.col("risk") >= high).select("item_id", F.explode_outer("covered").alias("path"))
    per = risky.join(tagged.withColumn("ok", F.lit(True)), "path", "left").groupBy("item_id").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"))
    total = per.agg(F.count(F.lit(1)).alias("demanded"), F.count_if("ok").alias("discharged"))
    return total.withColumn("coverage", F.when(F.col("demanded") == 0, 1.0).otherwise(F.col("discharged") / F.col("demanded")))
