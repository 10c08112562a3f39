"""A corpus pipeline: language, exact duplicates, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as
Parquet and reads them again. All but the last return the columns of docs, whatever others there are. Stages decide by
row, a row being known by its doc_id and text: rows that repeat an id with another text are documents of their own, those
that repeat both stay or go together. Null texts are empty; a null doc_id is a value like others, smaller than all. Empty
tables go through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.llm import blocknames, langid, neardup, packing, pii
from lintweave.llm.common import Shelf, documents

#: A document whose best language has a smaller share of its words has no clear language and goes, as do those without a letter.
MIN_SHARE = 0.4


def _fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names that no column of docs has."""
    taken = {x.lower() for x in docs.columns}
    return tuple(next(x for n in range(len(taken) + 1) if (x := name + "_" * n) not in taken) for name in names)


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, SHA-256 of the text) are in rows, null as a value of its own."""
    own_id, own_text = _fresh(docs, "_own_id", "_own_text")
    rows = rows.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_text)).distinct()
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col(own_id)) & (digest == F.col(own_text)), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from the labelled rows of docs, and without any all documents go.

    Texts without a letter, null ones too, have no language and go; a text whose languages tie at less than MIN_SHARE goes.
    """
    out = _fresh(docs, "_lang_pred", "_lang_score")
    judged = langid.predict(docs, langid.train(docs, ~langid.held_out()), out=out)
    return judged.filter((F.col(out[0]) != langid.UNKNOWN) & (F.col(out[1]) >= MIN_SHARE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null texts equal empty ones), the row with the largest id; rows that tie on it all stay."""
    return _only(docs, blocknames.exact_groups(docs, Shelf(spark, "exact")).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8), the row with the smallest id.

    Texts without words are near to none and stay. A row with a null id stays if no row with an id has its shingles.
    """
    groups = neardup.near_groups(docs, Shelf(spark, "near"), width=5, percent=80)
    return _only(docs, groups.filter("kept OR component_id IS NULL"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. Null texts stay null."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences; a null or empty text is a piece with the end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), Shelf(spark, "packed"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a data folder."""
    shelf, docs = Shelf(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        shelf.keep(name)
    return docs
