"""Specification operators on the driver's tables: documents as files, conversations as state machines, labels as verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintweave.operators import formal, markdown, review, termmine
from lintweave.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file in its source's folder."""
    path = F.concat(F.lit("components/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, tier, component and hash of each file."""
    rows = markdown.documents(_files(spark, sf_dir), [("src0/", "0"), ("src1", "1"), ("src2/", "meta")])
    return rows.select("path", F.coalesce("tier", F.lit("none")).alias("tier"), F.coalesce("tier_num", F.lit(-1)).alias("tier_num"), "component", "content_hash")


def spec_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each file: those without headings are one."""
    return markdown.sections(markdown.lines(_files(spark, sf_dir))).select("section_id", "level", "line_start", "line_end")


def spec_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English terms of three documents or more, with their frequencies."""
    bodies = _files(spark, sf_dir).select("path", F.lit(1).alias("section"), F.regexp_replace("content", "[^A-Za-z]", " ").alias("body"))
    found = termmine.candidates(bodies).filter("kind = 'english'")
    return found.groupBy("term").agg(F.countDistinct("path").alias("df"), F.count(F.lit(1)).alias("total")).filter("df >= 3")


def formal_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a machine over its roles: unreachable states, branching, verdict."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("model"), "turn", F.col("role").alias("state"))
    after = F.lead("state").over(Window.partitionBy("model").orderBy("turn"))
    edges = turns.select("model", F.col("state").alias("source"), after.alias("target"), F.lit(False).alias("guarded")).filter("target IS NOT NULL")
    first = turns.groupBy("model").agg(F.min_by("state", "turn").alias("state"))
    return formal.soundness(turns.select("model", "state"), first, edges)


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each source from its documents' labels: toxic is a sure failure, low quality an unsure one."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    failed = (F.col("toxic") == 1) | (F.col("quality") == 0)
    outcome = F.when(F.col("quality").isNull(), "skipped").when(failed, "fail").otherwise("pass")
    answers = rows.select(F.concat_ws(":", "source", "lang").alias("item_id"), outcome.alias("outcome"), F.lit("major").alias("severity"), F.when(F.col("toxic") == 1, 0.9).otherwise(0.5).alias("score"))
    return review.status(answers)


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four evenly spaced lines of each order: a sampling operator."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return review.sampled(rows, "l_orderkey", "l_partkey")


QUERIES = {f.__name__: f for f in (spec_documents, spec_sections, spec_terms, formal_soundness, review_status, review_sample)}
_F = "WITH f AS (SELECT 'components/' || source || '/' || doc_id || '.md' AS path, source, text FROM documents)"
ORACLE_SQL = {
    "spec_documents": _F + """ SELECT path, CASE WHEN source LIKE '%src0' THEN '0' WHEN source LIKE 'src1%' THEN '1' WHEN source = 'src2' THEN 'meta' ELSE 'none' END AS tier,
        CASE WHEN source LIKE '%src0' THEN 0 WHEN source LIKE 'src1%' THEN 1 ELSE -1 END AS tier_num, source AS component, sha256(text) AS content_hash FROM f""",
    "spec_sections": _F + " SELECT 'sec:' || path AS section_id, 0 AS level, 1 AS line_start, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_end FROM f",
    "spec_terms": f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' +')) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM t WHERE length(term) BETWEEN 3 AND 35
        AND lower(term) NOT IN ({", ".join(f"'{w}'" for w in termmine.STOP_WORDS)}) GROUP BY term HAVING count(DISTINCT doc_id) >= 3""",
    "formal_soundness": """WITH RECURSIVE t AS (SELECT conv_id AS model, role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations),
        r AS (SELECT conv_id AS model, arg_min(role, turn) AS state FROM conversations GROUP BY 1 UNION SELECT r.model, t.target FROM r JOIN t ON t.model = r.model AND t.source = r.state WHERE t.target IS NOT NULL),
        s AS (SELECT DISTINCT conv_id AS model, role AS state FROM conversations),
        b AS (SELECT model, max(n) AS branching FROM (SELECT model, source, count(DISTINCT target) AS n FROM t WHERE target <> source GROUP BY 1, 2) GROUP BY 1)
        SELECT s.model, count(*) AS states, count(*) FILTER (r.state IS NULL) AS unreachable, coalesce(max(b.branching), 0) AS branching,
        CASE WHEN count(*) < 2 OR count(*) FILTER (r.state IS NULL) > 0 THEN 'UNSOUND' WHEN coalesce(max(b.branching), 0) < 2 THEN 'VACUOUS' ELSE 'PASS' END AS verdict
        FROM s LEFT JOIN r ON r.model = s.model AND r.state = s.state LEFT JOIN b ON b.model = s.model GROUP BY s.model""",
    "review_status": """SELECT item_id, CASE WHEN failed > 0 THEN 'FAIL' WHEN warned > 0 THEN 'WARN' WHEN skipped = n THEN 'SKIPPED' ELSE 'PASS' END AS status, failed, warned, skipped
        FROM (SELECT source || ':' || lang AS item_id, count(*) AS n, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (toxic = 0 AND quality = 0) AS warned,
        count(*) FILTER (quality IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""",
    "review_sample": """WITH p AS (SELECT l_orderkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS i,
        count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, l_partkey, n FROM p WHERE m <= 4 OR i IN (0, round_even((m - 1) / 3, 0), round_even(2 * (m - 1) / 3, 0), m - 1)""",
}
