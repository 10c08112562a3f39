"""Links, anchors and comments of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.functions.text import anchor_slug
from lintweave.sources.tables import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link_no", "target"))
    return pages.select("page_id", "link_no", "target")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the pages' first headings: what links may point to."""
    heads = table(spark, sf_dir, "pages").select(F.explode(F.split(F.lower(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), " ")).alias("topic"))
    return heads.filter("topic <> ''").distinct()


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).withColumn("topic", F.lower(F.regexp_replace("target", "^/|[/?#].*$", "")))


def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links in page order, without mail and outer protocols, split at the first sign of an anchor."""
    rows = _links(spark, sf_dir).filter(~F.col("target").rlike("^(mailto|javascript):"))
    return rows.select("page_id", "link_no", F.split_part("target", F.lit("#"), F.lit(1)).alias("path"), F.split_part("target", F.lit("#"), F.lit(2)).alias("anchor"))


def links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose target is no heading's word."""
    return _keyed(spark, sf_dir).join(_topics(spark, sf_dir), "topic", "left_anti").select("page_id", "link_no", "target")


def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose target is a heading's word."""
    return _keyed(spark, sf_dir).join(_topics(spark, sf_dir), "topic", "left_semi").select("page_id", "link_no", "target")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of page urls, normalised, and whether the page's heading has that form."""
    pages = table(spark, sf_dir, "pages").filter("contains(url, '#')")
    anchor = F.regexp_extract("url", "#(.*)$", 1)
    head = anchor_slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    return pages.select("page_id", anchor.alias("anchor"), head.alias("heading"), (anchor_slug(anchor) == head).alias("found"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML comments with their content."""
    found = F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("c")).select("page_id", F.trim("c").alias("comment"))


QUERIES = {f.__name__: f for f in (links_all, links_broken, links_resolved, anchors, comments)}
_L = """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS s FROM pages),
    l AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, s[i] AS target FROM a, unnest(range(1, len(s) + 1)) t(i)),
    h AS (SELECT DISTINCT unnest(string_split(lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ' ')) AS topic FROM pages)"""
_K = "lower(regexp_replace(target, '^/|[/?#].*$', '', 'g'))"
ORACLE_SQL = {
    "links_all": _L + """ SELECT page_id, link_no, split_part(target, '#', 1) AS path, split_part(target, '#', 2) AS anchor FROM l
        WHERE target NOT LIKE 'mailto:%' AND target NOT LIKE 'javascript:%'""",
    "links_broken": _L + f" SELECT page_id, link_no, target FROM l WHERE {_K} NOT IN (SELECT topic FROM h WHERE topic <> '')",
    "links_resolved": _L + f" SELECT page_id, link_no, target FROM l WHERE {_K} IN (SELECT topic FROM h WHERE topic <> '')",
    "anchors": """SELECT page_id, anchor, heading, anchor = heading AS found FROM (SELECT page_id, split_part(url, '#', 2) AS anchor,
        replace(regexp_replace(trim(lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), ' ', '-') AS heading
        FROM pages WHERE contains(url, '#'))""",
    "comments": "SELECT page_id, trim(unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1))) AS comment FROM pages",
}
