"""Consistency checks: repeated definitions, drifting values, stale passages, extracted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import invariants
from lintweave.operators.lines import lines_of
from lintweave.sources.tables import table

#: Passages that one automaton holds, in each worker.
AUTOMATON = 20_000


def _long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    return rows.filter(F.length("line") >= 20)


def dup_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in two documents or more; reported at the second."""
    per = _long_lines(spark, sf_dir).groupBy("line", "doc_id").agg(F.min("line_no").alias("line_no"))
    # two minima, each pre-aggregated, in place of a rank within a line that very many documents may have
    first = per.groupBy("line").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = per.join(first, "line").filter("doc_id > first").groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    return later.select("at.doc_id", "at.line_no", F.sha2("line", 256).alias("sha256"))


def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that 2 to 6 documents share."""
    per = _long_lines(spark, sf_dir).groupBy("line").agg(F.countDistinct("doc_id").alias("files"), F.count(F.lit(1)).alias("sections"), F.min("doc_id").alias("first_doc"))
    return per.filter("files BETWEEN 2 AND 6").select(F.sha2("line", 256).alias("sha256"), "files", "sections", "first_doc")


def dup_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes with the number of documents that have it."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def stale_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents contain.

    As many as one automaton holds are looked for in one scan of the documents, which shuffles nothing. Of more passages,
    words 2 to 4 are whole words wherever a passage stands, so they are its key in an equi-join with the three-word
    runs of documents; the passage itself is looked for only where its key is. Passages of fewer than five words have no
    such key: an automaton looks for all of them at once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lambda c: F.split(c, r"\s+")
    rules = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    if rules.limit(AUTOMATON + 1).count() <= AUTOMATON:
        return invariants.contained_rules(docs, rules, "item_id", "passage", AUTOMATON).withColumnRenamed("needle", "item_id")
    keys = rules.filter(F.size(words("passage")) >= 5).select("item_id", F.concat_ws(" ", F.slice(words("passage"), 2, 3)).alias("key"))
    w = docs.select("doc_id", words("text").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))
    near = w.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()
    found = near.join(docs, "doc_id").join(rules, "item_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    short = invariants.contained_rules(docs, rules.filter(F.size(words("passage")) < 5), "item_id", "passage")
    return found.unionByName(short.withColumnRenamed("needle", "item_id"))


def symbol_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with several brands: how many, the first brand and the first place."""
    per = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("place"))
    own = per.groupBy("p_name").agg(F.count(F.lit(1)).alias("n_values"), F.min("p_brand").alias("first_value"), F.min("place").alias("first_place"))
    return own.filter("n_values >= 2")


def extract_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values assigned to a token, by document."""
    found = F.regexp_extract_all("text", F.lit('token = "([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("value"))


def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, by document."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


QUERIES = {f.__name__: f for f in (dup_definition, keyword_groups, dup_document, stale_value, symbol_drift, extract_tokens, extract_emails)}
_L = "WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(i) WHERE length(s[i]) >= 20)"
ORACLE_SQL = {
    "dup_definition": _L + """ SELECT doc_id, line_no, sha256(line) AS sha256 FROM (SELECT line, doc_id, min(line_no) AS line_no,
        row_number() OVER (PARTITION BY line ORDER BY doc_id) AS n FROM l GROUP BY line, doc_id) WHERE n = 2""",
    "keyword_groups": _L + """ SELECT sha256(line) AS sha256, count(DISTINCT doc_id) AS files, count(*) AS sections, min(doc_id) AS first_doc
        FROM l GROUP BY line HAVING count(DISTINCT doc_id) BETWEEN 2 AND 6""",
    "dup_document": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text",
    "stale_value": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "symbol_drift": """SELECT p_name, count(DISTINCT p_brand) AS n_values, min(p_brand) AS first_value, min(p_partkey) AS first_place
        FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2""",
    "extract_tokens": """SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([^"]*)"', 1)) AS value FROM documents""",
    "extract_emails": "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]')) AS email FROM documents",
}
