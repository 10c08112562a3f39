"""Reports as Markdown: tables of bounded relations, rendered as lines on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(*columns: str) -> Column:
    """A table row; bars and line ends in values are written so that they don't end a cell."""
    text = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), "[\r\n]+", " ") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))


def table_lines(rows: DataFrame, section: int, title: str, columns: list[str], order: list[Column]) -> DataFrame:
    """(section, part, ord, line): heading, head and rows of a table; an empty relation has a remark in place of rows."""
    spark = rows.sparkSession
    head = [(section, 0, f"## {section}. {title}"), (section, 1, ""), (section, 2, "| " + " | ".join(columns) + " |"), (section, 3, "|" + " --- |" * len(columns))]
    top = spark.createDataFrame(head, "section int, part int, line string").select("section", "part", F.array().cast("array<string>").alias("ord"), "line")
    keys = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in order))
    body = rows.select(F.lit(section).alias("section"), F.lit(4).alias("part"), keys.alias("ord"), cells(*columns).alias("line"))
    none = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(section).alias("section"), F.lit(5).alias("part"), F.array().cast("array<string>").alias("ord"), F.lit("None.").alias("line"))
    return top.unionByName(body).unionByName(none)


def rendered(lines: DataFrame) -> str:
    """The report's text: it is for a person to read, its tables are bounded by gates, rules and limits."""
    return "\n".join(r.line for r in lines.orderBy("section", "part", "ord", "line").toLocalIterator()) + "\n"


def by_gate(issues: DataFrame, gates: tuple[str, ...]) -> DataFrame:
    """(ord, gate, errors, warnings, status) of all gates in order."""
    counts = issues.groupBy("gate").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    rows = issues.sparkSession.createDataFrame([(i, g) for i, g in enumerate(gates)], "ord int, gate string").join(counts, "gate", "left").fillna(0)
    return rows.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def markdown_report(issues: DataFrame, gates: tuple[str, ...], detail: int = 200) -> str:
    """Totals, gates, rules, and the first issues in order of gate, severity, path and line."""
    total = issues.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_if(F.col("severity") == "INFO").alias("infos"))
    gate_rows = by_gate(issues, gates).withColumn("at", F.lpad(F.col("ord").cast("string"), 4, "0"))
    rules = issues.groupBy("gate", "severity", "rule_code").agg(F.count(F.lit(1)).alias("n"))
    first = issues.orderBy("gate", "severity", "path", "line", "rule_code", "message").limit(detail).withColumn("at", F.lpad(F.col("line").cast("string"), 9, "0"))
    parts = (
        table_lines(total, 1, "Summary", ["errors", "warnings", "infos"], [F.lit("")]),
        table_lines(gate_rows, 2, "Gates", ["gate", "errors", "warnings", "status"], [F.col("at")]),
        table_lines(rules, 3, "Rules", ["gate", "severity", "rule_code", "n"], [F.col("gate"), F.col("severity"), F.col("rule_code")]),
        table_lines(first, 4, "Issues", ["gate", "severity", "path", "line", "rule_code", "message"], [F.col("gate"), F.col("severity"), F.col("path"), F.col("at")]),
    )
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return "# Verification report\n\n" + rendered(lines)


def risk_lines(assessed: DataFrame, threshold: int = 4) -> DataFrame:
    """(section, part, ord, line) of the risk report: risky items (keyword, path, complexity, risk, summary), then all, the riskiest first."""
    order = [F.lpad((F.lit(9) - F.col("risk")).cast("string"), 2, "0"), F.col("keyword")]
    columns = ["keyword", "path", "complexity", "risk", "summary"]
    return table_lines(assessed.filter(F.col("risk") >= threshold), 1, f"Risk of {threshold} or more", columns, order).unionByName(table_lines(assessed, 2, "All", columns, order))
