"""Reports over the checks' issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.sources.tables import table

from . import consistency, identifiers, ledger, links

# The gates of the report, in order.
GATES = ("Link", "Traceability", "Hierarchy", "Formal", "WIT", "Evidence", "Obligation", "Consistency", "Identifier", "Topic")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gate, severity, rule_code, item): the issues of several checks as one relation."""
    parts = (
        (identifiers.id_unreferenced, "Identifier", "WARNING", "ID-UNREFERENCED-DEFINITION", "item"),
        (identifiers.id_duplicate, "Identifier", "ERROR", "ID-DUPLICATE-DEFINITION", "l_orderkey"),
        (identifiers.id_serial_gaps, "Identifier", "INFO", "ID-SERIAL-GAPS", "l_orderkey"),
        (links.links_broken, "Link", "ERROR", "FMT-BROKEN-LINK", "page_id"),
        (consistency.dup_definition, "Consistency", "ERROR", "CONSIST-DUPLICATE-DEFINITION", "doc_id"),
        (consistency.stale_value, "Consistency", "ERROR", "CONSIST-STALE-VALUE", "doc_id"),
        (ledger.obligation_skipped, "Obligation", "ERROR", "OBLIG-VERIFICATION-SKIPPED", "doc_id"),
        (ledger.obligation_failed, "Obligation", "ERROR", "OBLIG-JUDGE-FAILED", "doc_id"),
    )
    rows = [f(spark, sf_dir).select(F.lit(g).alias("gate"), F.lit(s).alias("severity"), F.lit(r).alias("rule_code"), F.col(i).cast("long").alias("item")) for f, g, s, r, i in parts]
    return reduce(DataFrame.unionByName, rows)


def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each gate, gates without any too."""
    counts = issues(spark, sf_dir).groupBy("gate").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    gates = spark.createDataFrame([(i, g) for i, g in enumerate(GATES)], "ord int, gate string")
    rows = gates.join(counts, "gate", "left").select("ord", "gate", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    return rows.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by rule."""
    return issues(spark, sf_dir).groupBy("gate", "severity", "rule_code").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals."""
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.split("text", "\n"))).alias("sections"))
    found = issues(spark, sf_dir).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return docs.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k").drop("k")


QUERIES = {f.__name__: f for f in (report_gates, report_rules, report_summary)}
_parts = (
    (identifiers, "id_unreferenced", "Identifier", "WARNING", "ID-UNREFERENCED-DEFINITION", "item"),
    (identifiers, "id_duplicate", "Identifier", "ERROR", "ID-DUPLICATE-DEFINITION", "l_orderkey"),
    (identifiers, "id_serial_gaps", "Identifier", "INFO", "ID-SERIAL-GAPS", "l_orderkey"),
    (links, "links_broken", "Link", "ERROR", "FMT-BROKEN-LINK", "page_id"),
    (consistency, "dup_definition", "Consistency", "ERROR", "CONSIST-DUPLICATE-DEFINITION", "doc_id"),
    (consistency, "stale_value", "Consistency", "ERROR", "CONSIST-STALE-VALUE", "doc_id"),
    (ledger, "obligation_skipped", "Obligation", "ERROR", "OBLIG-VERIFICATION-SKIPPED", "doc_id"),
    (ledger, "obligation_failed", "Obligation", "ERROR", "OBLIG-JUDGE-FAILED", "doc_id"),
)
_I = "WITH i AS (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, '{s}' AS severity, '{r}' AS rule_code, CAST({i} AS BIGINT) AS item FROM ({m.ORACLE_SQL[q]})" for m, q, g, s, r, i in _parts) + ")"
ORACLE_SQL = {
    "report_gates": _I + f""" SELECT ord, gate, errors, warnings, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM
        (SELECT ord, g.gate, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings
        FROM (VALUES {", ".join(f"({k}, '{g}')" for k, g in enumerate(GATES))}) g(ord, gate) LEFT JOIN i ON i.gate = g.gate GROUP BY ALL)""",
    "report_rules": _I + " SELECT gate, severity, rule_code, count(*) AS n, min(item) AS first_item FROM i GROUP BY ALL",
    "report_summary": _I + """ SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents) AS sections,
        count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM i""",
}
