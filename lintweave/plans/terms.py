"""Term mining and spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators.lines import lines_of
from lintweave.operators.typos import spelling_pairs
from lintweave.sources.tables import table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("term"))


def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most frequent terms with document frequency and largest tf-idf; a report of a fixed length."""
    n_docs = F.lit(table(spark, sf_dir, "documents").count())
    per = _terms(spark, sf_dir).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    size = per.groupBy("doc_id").agg(F.sum("n").alias("size"))
    by_term = per.join(size, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"), F.max(F.col("n") / F.col("size")).alias("tf"))
    scored = by_term.withColumn("score", F.round(F.col("tf") * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1), 6))
    return scored.orderBy(F.desc("total"), "term").limit(500).select("term", "df", "total", "score")


def term_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document and number of occurrences of each term in three documents or more."""
    per = _terms(spark, sf_dir).groupBy("term").agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("total"))
    return per.filter("df >= 3")


def typo_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one line that differ in their last letter only, or by one letter at the end."""
    lines = lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    found = F.array_distinct(F.regexp_extract_all("line", F.lit("[a-z]{6,}"), F.lit(0)))
    return spelling_pairs(lines.select("doc_id", "line_no", F.explode(found).alias("word")), ["doc_id", "line_no"], least=6)


QUERIES = {f.__name__: f for f in (tfidf_top, term_first, typo_english)}
_T = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents)"
ORACLE_SQL = {
    "tfidf_top": _T + """, p AS (SELECT doc_id, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS size FROM t GROUP BY doc_id, term)
        SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total,
        round(max(n / size) * (ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1), 6) AS score
        FROM p GROUP BY term ORDER BY total DESC, term LIMIT 500""",
    "term_first": _T + " SELECT term, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS df, count(*) AS total FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 3",
    "typo_english": """WITH l AS (SELECT doc_id, i AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(i)),
        w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]{6,}')) AS word FROM l)
        SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_lines, min(a.doc_id) AS first_doc FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.word < b.word
        WHERE (length(a.word) = length(b.word) AND left(a.word, length(a.word) - 1) = left(b.word, length(b.word) - 1))
        OR (length(a.word) + 1 = length(b.word) AND starts_with(b.word, a.word)) GROUP BY ALL""",
}
