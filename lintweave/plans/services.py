"""Answers of model services on the driver's tables; the services are functions that count letters and fail by plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import client
from lintweave.sources.tables import table
from lintweave.sources.work import shared_folder

POLICY = client.Policy(pause=0.0)


def counting(payload: dict) -> tuple[int, dict | None]:
    """Vectors of length, e's and blanks; a request with a text whose length 41 divides is refused."""
    texts = payload["input"]
    if any(len(t) % 41 == 0 for t in texts):
        return 400, None
    return 200, {"embeddings": [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]}


def deciding(payload: dict) -> tuple[int, dict | None]:
    """Whether a text has more than so many characters; the longest are too many for the service."""
    n = len(payload["state"])
    if n > 8000:
        return 413, None
    return 200, {"answers": {"long": n > payload["questions"]["long"]["limit"], "size": n // 100}}


def _answers(spark: SparkSession, name: str, kind: str) -> client.Answers:
    return client.Answers(spark, f"{shared_folder(spark)}/lintweave-{name}-{uuid.uuid4().hex}", kind)


def embed_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings after a run: a third of the documents has one, a third has one of an older text, the rest none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 3 < 2 AND text IS NOT NULL").select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("digest"), F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)).alias("vector")
    )
    next_ = client.embedded(docs, old, _answers(spark, "embed", "array<double>"), client.vectors(counting, "counts", 3), "doc_id", POLICY)
    return next_.select("doc_id", F.col("digest").alias("digest"), *(F.col("vector")[i].alias(n) for i, n in enumerate(("chars", "es", "blanks"))))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on each document, or why there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    answers = _answers(spark, "decide", "string")
    answers.ask(docs, client.decisions(deciding, "rules", {"long": {"limit": 500}}), policy=POLICY)
    out = answers.answered(docs)
    return out.select("doc_id", F.get_json_object("answer", "$.long").alias("is_long"), F.get_json_object("answer", "$.size").cast("long").alias("size"), "error")


QUERIES = {f.__name__: f for f in (embed_todo, decided)}
ORACLE_SQL = {
    "embed_todo": """SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN -1.0::DOUBLE ELSE length(text)::DOUBLE END AS chars,
        CASE WHEN doc_id % 3 = 0 THEN 0::DOUBLE ELSE (length(text) - length(replace(text, 'e', '')))::DOUBLE END AS es, CASE WHEN doc_id % 3 = 0 THEN 0::DOUBLE ELSE (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS blanks
        FROM documents WHERE text IS NOT NULL AND (doc_id % 3 = 0 OR length(text) % 41 <> 0)""",
    "decided": """SELECT doc_id, CASE WHEN length(text) > 8000 THEN NULL WHEN length(text) > 500 THEN 'true' WHEN text IS NOT NULL THEN 'false' END AS is_long,
        CASE WHEN length(text) <= 8000 THEN length(text) // 100 END AS size, CASE WHEN length(text) > 8000 THEN 'Refused: status 413' END AS error FROM documents""",
}
