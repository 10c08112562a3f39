"""Lines and sections of documents, fences, as-of joins and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintweave.operators.lines import lines_of, nearest_smaller, parity
from lintweave.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by number."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n_chars"), F.sha2("line", 256).alias("sha256"))


def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections: each line of under 60 characters is a heading that ends before the next one."""
    rows = _lines(spark, sf_dir)
    last = rows.groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    heads = rows.filter(F.length("line") < 60).select("doc_id", F.col("line_no").alias("line_start"))
    heads = heads.withColumn("after", F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("line_start")))
    return heads.join(last, "doc_id").select("doc_id", "line_start", F.coalesce(F.col("after") - 1, "last_line").alias("line_end"))


def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line is inside a fence; lines with a bar open and close fences and aren't inside."""
    return parity(_lines(spark, sf_dir), F.contains(F.col("line"), F.lit("|")), ["doc_id"], "line_no").select("doc_id", "line_no", "is_fence", "inside")


def section_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest line before, in the document, with a smaller level; a line's level is its length's class of four."""
    levels = _lines(spark, sf_dir).select("doc_id", "line_no", (F.length("line") % 4 + 1).alias("level"))
    return nearest_smaller(levels, ["doc_id"], "line_no", "level", 4).withColumn("parent", F.coalesce("parent", F.lit(0)))


def asof_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup at or before each purchase of a user."""
    own = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "signup").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    rows = rows.withColumn("signup_ts", F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(own))
    return rows.filter("event_type = 'purchase' AND signup_ts IS NOT NULL").select("event_id", "user_id", "signup_ts")


def format_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that white-space normalisation changes: no blanks at line ends, one newline at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.rtrim(x)), "\n")
    clean = F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n"))
    return docs.select("doc_id", F.sha2(clean, 256).alias("sha256"), (clean != F.col("text")).alias("changed")).filter("changed")


def long_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of over 100 characters that aren't white space."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("sentence_no", "sentence"))
    n = F.length(F.regexp_replace("sentence", "[ \t\n]", "")).alias("n_chars")
    return docs.select("doc_id", "sentence_no", n).filter("n_chars > 100")


def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, component and tier of each document."""
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("source").alias("component"), tier.alias("tier"))


QUERIES = {f.__name__: f for f in (section_lines, section_bounds, fence_state, section_parent, asof_event, format_changed, long_sentence, document_hash)}
_L = "WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(i))"
ORACLE_SQL = {
    "section_lines": _L + " SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS n_chars, sha256(line) AS sha256 FROM l",
    "section_bounds": _L + """, h AS (SELECT doc_id, line_no FROM l WHERE length(line) < 60)
        SELECT h.doc_id, h.line_no AS line_start, CAST(coalesce((SELECT min(n.line_no) - 1 FROM h n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no),
        (SELECT max(l.line_no) FROM l WHERE l.doc_id = h.doc_id)) AS INTEGER) AS line_end FROM h""",
    "fence_state": _L + """ SELECT doc_id, line_no, line LIKE '%|%' AS is_fence,
        line NOT LIKE '%|%' AND count(*) FILTER (line LIKE '%|%') OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS inside FROM l""",
    "section_parent": _L + """, v AS (SELECT doc_id, line_no, CAST(length(line) % 4 + 1 AS INTEGER) AS level FROM l)
        SELECT v.doc_id, v.line_no, v.level, CAST(coalesce(max(p.line_no), 0) AS INTEGER) AS parent FROM v LEFT JOIN v p
        ON p.doc_id = v.doc_id AND p.line_no < v.line_no AND p.level < v.level GROUP BY ALL""",
    "asof_event": """
        SELECT p.event_id, p.user_id, s.ts AS signup_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "format_changed": """
        SELECT doc_id, sha256(clean) AS sha256, clean <> text AS changed FROM (SELECT doc_id, text,
        rtrim(array_to_string([rtrim(x, ' ') FOR x IN string_split(text, chr(10))], chr(10)), chr(10)) || chr(10) AS clean FROM documents) WHERE clean <> text""",
    "long_sentence": """
        SELECT * FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, CAST(length(regexp_replace(s[i], '[ \\t\\n]', '', 'g')) AS INTEGER) AS n_chars
        FROM (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS s FROM documents), unnest(range(1, len(s) + 1)) t(i)) WHERE n_chars > 100""",
    "document_hash": """
        SELECT doc_id, sha256(text) AS content_hash, source AS component,
        CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS tier FROM documents""",
}
