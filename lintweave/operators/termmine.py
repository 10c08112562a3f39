"""Term mining on Markdown text: candidates by kind, scores, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of terms; a stretch of text may give terms of several kinds.
KINDS = {
    "spec_keyword": r"\{([A-Za-z0-9_\-]{3,})\}",
    "katakana": r"([ァ-ヴー]{2,})",
    "katakana_kanji": r"([ァ-ヴー]+[一-龯]+)",
    "kanji": r"([一-龯]{2,})",
    "english": r"\b([A-Za-z][A-Za-z0-9_\-]{2,})\b",
}
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "are", "not", "was", "has", "have", "will", "can", "you", "all")


def plain(text: Column) -> Column:
    """Markdown without fences, comments, code, images, link targets and heading marks."""
    for pattern, new in ((r"(?s)```.*?```", " "), (r"(?s)<!--.*?-->", " "), (r"`[^`\n]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", "")):
        text = F.regexp_replace(text, pattern, new)
    return text


def candidates(sections: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(path, section, term, kind, ord) of (path, section, body): every occurrence of a term of 2 to 35 characters."""
    body = plain(F.coalesce("body", F.lit("")))
    raw = F.coalesce("body", F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(raw if kind == "spec_keyword" else body, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))

    each = sections.select("path", "section", F.posexplode(F.concat(*(of(k, p) for k, p in KINDS.items()))).alias("ord", "t")).select("path", "section", "t.term", "t.kind", "ord")
    return each.filter(F.length("term").between(2, 35) & ~F.lower("term").isin(*stop_words))


def scored(found: DataFrame, n_docs: int, top: int = 500) -> DataFrame:
    """(term, kind, df, total, score), a report of the top terms: by total, then score, then the term.

    score is the largest over documents of tf * (ln((N + 1) / (df + 1)) + 1); a term's kind is that of its last occurrence.
    """
    per = found.groupBy("path", "term").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("section", "ord", "kind")).alias("last"))
    size = per.groupBy("path").agg(F.sum("n").alias("size"))
    by = per.join(size, "path").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"), F.max(F.col("n") / F.col("size")).alias("tf"), F.max_by("last.kind", F.struct("path", "last")).alias("kind"))
    score = F.col("tf") * (F.log(F.lit(n_docs + 1) / (F.col("df") + 1)) + 1)
    return by.select("term", "kind", "df", "total", score.alias("score")).orderBy(F.desc("total"), F.desc("score"), "term").limit(top)


def occurrences(found: DataFrame, sections: DataFrame, around: int = 40) -> DataFrame:
    """(term, path, section, snippet): the first occurrence in each section with the text around it on one line."""
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("term", "path", "section").orderBy("ord"))).filter("n = 1").select("term", "path", "section")
    rows = first.join(sections.select("path", "section", "body"), ["path", "section"])
    at = F.expr("locate(term, body)")
    start = F.greatest(F.lit(1), at - around)
    cut = F.substring("body", start, (at - start) + F.length("term") + around)
    return rows.select("term", "path", "section", F.trim(F.replace(cut, F.lit("\n"), F.lit(" "))).alias("snippet"))
