"""The obligation ledger: what is assessed, stale, failed; findings and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.functions.text import half_even
from lintweave.sources.tables import table


def obligation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed, high-risk and failed documents by source, and the share that is assessed (1 if none is asked for)."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("demanded"),
        F.count("quality").alias("discharged"),
        F.count_if(F.col("quality") == 0).alias("high_risk"),
        F.count_if(F.col("toxic") == 1).alias("failed"),
        F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("coverage"),
    )


def obligation_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-risk documents that no failed assessment covers."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter("quality = 0 AND toxic = 0").select("doc_id", F.lit("OBLIG-VERIFICATION-SKIPPED").alias("rule_code"))


def obligation_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed documents with their source."""
    failed = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(failed, "doc_id", "left_semi").select("doc_id", "source")


def assessment_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed documents whose hash differs from the assessed one, here the hash of the text without its last sign."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    then = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2(F.regexp_replace("text", r"\.\z", ""), 256).alias("assessed_hash"))
    return docs.join(then, "doc_id").filter(F.col("assessed_hash") != F.sha2("text", 256)).select("doc_id", "assessed_hash")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of at least 50, best first; a listing of 200."""
    rows = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase') AND value >= 50")
    return rows.orderBy(F.desc("value"), "event_id").limit(200).select("event_id", "user_id", "event_type", "value")


def evidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and values of events' properties."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return rows.select("event_id", "key", "value")


def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, the worst status: FAIL, then WARN, else SKIPPED if all are, else PASS."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rank = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when(F.col("quality") == 1, 1).otherwise(0)
    worst = rows.groupBy("source", "lang").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n"))
    return worst.select("source", "lang", "n", F.when(F.col("r") == 3, "FAIL").when(F.col("r") == 2, "WARN").when(F.col("r") == 1, "PASS").otherwise("SKIPPED").alias("status"))


def severity_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of each event taken as a verdict: errors of little confidence are warnings."""
    score = F.col("value") / 100
    severity = F.when(F.col("event_type") == "purchase", F.when(score >= 0.7, "ERROR").otherwise("WARNING")).when(F.col("event_type") == "signup", "INFO")
    return table(spark, sf_dir, "events").select("event_id", severity.alias("severity")).filter("severity IS NOT NULL")


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' risk from 1 to 5: their size scaled to 0 to 4 and rounded, halves to even."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.col("p_size") / F.lit(12.5)))
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(5), F.greatest(F.lit(1), half_even(scaled) + 1)).alias("risk"))


def definition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of large orders with their definition, or a placeholder where it isn't finished."""
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    refs = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40").select("l_orderkey", "l_linenumber", "l_partkey")
    return refs.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("o_orderpriority", F.lit("missing-definition")).alias("definition"))


QUERIES = {f.__name__: f for f in (obligation_summary, obligation_skipped, obligation_failed, assessment_stale, findings, evidence_map, status_lattice, severity_of, risk_score, definition_pairs)}
ORACLE_SQL = {
    "obligation_summary": """SELECT source, count(*) AS demanded, count(quality) AS discharged, count(*) FILTER (quality = 0) AS high_risk,
        count(*) FILTER (toxic = 1) AS failed, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "obligation_skipped": "SELECT doc_id, 'OBLIG-VERIFICATION-SKIPPED' AS rule_code FROM labels WHERE quality = 0 AND toxic = 0",
    "obligation_failed": "SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)",
    "assessment_stale": """SELECT doc_id, sha256(left(text, length(text) - 1)) AS assessed_hash FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels) AND text LIKE '%.'""",
    "findings": "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value >= 50 ORDER BY value DESC, event_id LIMIT 200",
    "evidence_map": "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "status_lattice": """SELECT source, lang, count(*) AS n, CASE WHEN bool_or(coalesce(toxic, 0) = 1) THEN 'FAIL' WHEN bool_or(coalesce(quality, 1) = 0) THEN 'WARN'
        WHEN count(quality) = 0 THEN 'SKIPPED' ELSE 'PASS' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""",
    "severity_of": """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'INFO' WHEN value / 100 >= 0.7 THEN 'ERROR' ELSE 'WARNING' END AS severity
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "risk_score": "SELECT p_partkey, CAST(least(5, greatest(1, round_even(least(4.0, greatest(0.0, p_size / CAST(12.5 AS DOUBLE))), 0) + 1)) AS INTEGER) AS risk FROM part",
    "definition_pairs": """SELECT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F'), 'missing-definition') AS definition
        FROM lineitem WHERE l_quantity >= 40""",
}
