"""Vector similarity: pairs, topics and what still needs a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import vectors as operators
from lintweave.operators.vectors import cosine_pairs as pairs_of
from lintweave.sources.tables import table


def _pairs(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    """With both labels, which come with the vectors."""
    found = pairs_of(table(spark, sf_dir, "embeddings"), threshold, "vec_id", "embedding", keep=("label",))
    return found.select("a", "b", "label_a", "label_b", F.round("similarity", 4).alias("similarity"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.3 or more."""
    return _pairs(spark, sf_dir, 0.3)


def cosine_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of 0.35 or more across labels."""
    return _pairs(spark, sf_dir, 0.35).filter("label_a <> label_b")


def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most similar pairs, a report of a fixed length; ties by ids."""
    return _pairs(spark, sf_dir, 0.3).orderBy(F.desc("similarity"), "a", "b").limit(100)


def topic_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs across labels that are duplicates (0.45) or related (0.35) without a document source in common."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    side = lambda x: sources.select(F.col("doc_id").alias(x), F.col("source").alias(f"source_{x}"))
    near = cosine_cross(spark, sf_dir).join(side("a"), "a").join(side("b"), "b")
    rule = F.when(F.col("similarity") >= 0.45, "SEM-TOPIC-DUPLICATE").when(F.col("source_a") != F.col("source_b"), "SEM-TOPIC-UNLINKED")
    return near.select("a", "b", "similarity", rule.alias("rule_code")).filter("rule_code IS NOT NULL")


def embedding_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an assessment."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def term_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most similar pairs of terms; each second term is the one before it in capitals, with the same vector.

    Blocks are small here, so that pivots, rings and pruning take part at any size of the table.
    """
    rows = table(spark, sf_dir, "embeddings")
    own = rows.filter("vec_id % 2 = 0").selectExpr("'term ' || vec_id AS term", "embedding AS vector")
    return operators.similar_terms(own.unionByName(own.withColumn("term", F.upper("term"))), 0.3, block_rows=64)


def section_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand most similar pairs of sections across files: documents with enough text, by source."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("path"), F.col("text").alias("body"))
    own = table(spark, sf_dir, "embeddings").join(texts, "vec_id").selectExpr("vec_id AS section_id", "path", "body", "embedding AS vector")
    return operators.similar_sections(own, 0.3, block_rows=64)


QUERIES = {f.__name__: f for f in (cosine_pairs, cosine_cross, cosine_top, topic_unlinked, embedding_todo, term_similarity, section_similarity)}
_P = """WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS label_a, y.label AS label_b,
    list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"""
ORACLE_SQL = {
    "cosine_pairs": _P + " SELECT a, b, label_a, label_b, round(s, 4) AS similarity FROM p WHERE s >= 0.3",
    "cosine_cross": _P + " SELECT a, b, label_a, label_b, round(s, 4) AS similarity FROM p WHERE s >= 0.35 AND label_a <> label_b",
    "cosine_top": _P + " SELECT a, b, label_a, label_b, round(s, 4) AS similarity FROM p WHERE s >= 0.3 ORDER BY similarity DESC, a, b LIMIT 100",
    "topic_unlinked": _P + """ SELECT a, b, round(s, 4) AS similarity, CASE WHEN round(s, 4) >= 0.45 THEN 'SEM-TOPIC-DUPLICATE' ELSE 'SEM-TOPIC-UNLINKED' END AS rule_code
        FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b
        WHERE s >= 0.35 AND label_a <> label_b AND (round(s, 4) >= 0.45 OR x.source <> y.source)""",
    "term_similarity": """WITH e AS (SELECT 'term ' || vec_id AS term, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT * FROM e UNION ALL SELECT upper(term), v FROM e)
        SELECT x.term AS term_a, y.term AS term_b, round(list_cosine_similarity(x.v, y.v), 4) AS similarity FROM t x JOIN t y ON x.term < y.term AND lower(x.term) <> lower(y.term)
        WHERE list_cosine_similarity(x.v, y.v) >= 0.3 ORDER BY similarity DESC, term_a, term_b LIMIT 500""",
    "section_similarity": """WITH t AS (SELECT vec_id AS id, source, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN documents ON doc_id = vec_id
        WHERE length(regexp_replace(text, '^[\\s\\x0b\\x85\\p{Z}]+|[\\s\\x0b\\x85\\p{Z}]+$', '', 'g')) >= 60)
        SELECT x.id AS section_a, y.id AS section_b, x.source AS path_a, y.source AS path_b, round(list_cosine_similarity(x.v, y.v), 4) AS similarity FROM t x JOIN t y ON x.id < y.id AND x.source <> y.source
        WHERE list_cosine_similarity(x.v, y.v) >= 0.3 ORDER BY similarity DESC, section_a, section_b LIMIT 1000""",
    "embedding_todo": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
}
