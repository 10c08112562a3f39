"""Checks on a second corpus made from the orders: other forms of links, fences and comments than the first has.

With k an order's number, its file docs/p<k % 4>/d<k>.md has the lines that ``files`` lists; the SQL says from k what is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import blocks, gates, markdown, states
from lintweave.sources.tables import dealt, table

_OWN = "'docs/p' || (k % 4) || '/d' || k || '.md'"
_LINES = (
    "'# D ' || k",
    "CASE k % 5 WHEN 0 THEN '[d.md](/docs/p0/d.md)' WHEN 1 THEN '[x](../p1/d' || k || '.md)' WHEN 2 THEN '[d' || (k + 4) || '.md](d' || (k + 4) || '.md)' "
    f"WHEN 3 THEN '[ `d' || k || '.md`](' || {_OWN} || ')' ELSE '[other](' || {_OWN} || '#d-' || k || ')' END",
    f"IF(k % 3 = 0, 'See ' || {_OWN} || ' here, 本文.', 'See docs/none.md and x/' || {_OWN} || '.')",
    "IF(k % 2 = 0, '  <!-- from here', 'plain')",
    _OWN,
    "'it ends --> here'",
    "' ```text'",
    _OWN,
    "'~~~'",
    "'```'",
    f"'tail (' || {_OWN} || ') and -' || {_OWN} || ', [d](' || {_OWN} || ')'",
    f"'--- ' || {_OWN}",
    f"'<!-- one --> ' || {_OWN}",
    "IF(k % 7 = 0, '<!--', 'no')",
    "'```'",
    "'-->'",
    "'```'",
    _OWN,
    "'-->'",
    f"'last ' || {_OWN} || 'x ' || {_OWN} || '.'",
)


def corpus(spark: SparkSession, sf_dir: str) -> gates.Corpus:
    body = f"concat_ws('\\n', {', '.join(_LINES)})"
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return gates.Corpus(rows.selectExpr(f"{_OWN} AS path", f"{body} AS content"), [("^docs/p0/", "0")])


def shape_bare_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that prose names without a link, outside fences and comments of several lines."""
    return states.bare_paths(corpus(spark, sf_dir)).select("severity", "path", "line", "rule_code", "message")


def shape_link_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are absolute, climb folders, begin at the document's folder or have another label."""
    return gates.file_link_format(corpus(spark, sf_dir)).select("severity", "path", "line", "rule_code", "message")


def _indexed(spark: SparkSession, sf_dir: str) -> gates.Corpus:
    """A file docs/q<k % 4>/r<k>.md for each order, with a table of two keywords."""
    at = "'docs/q' || (k % 4) || '/r' || k || '.md'"
    next_at = "'docs/q' || ((k + 1) % 4) || '/r' || (k + 1) || '.md'"
    lines = (
        "'# R ' || k", "IF(k % 4 = 0, '<!-- definition: {REG_' || k || '} -->', 'none')", "'{REG_' || k || '}'", "'a | b'", "'| Keyword | Note | Source |'", "'| --- | :-: |---:|'",
        f"'| {{REG_' || k || '}} | x | [r' || k || '.md](' || {at} || ') |'",
        rf"'| `{{REG_' || (k + 1) || '}}` \\| or | | ' || CASE k % 3 WHEN 0 THEN 'a/b.md, c/d.md' WHEN 1 THEN '' ELSE {next_at} END || ' |'",
        "'text'", "'| {REG_none} | x | y |'",
    )
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return gates.Corpus(rows.selectExpr(f"{at} AS path", f"concat_ws('\n', {', '.join(lines)}) AS content"), [])


def shape_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with their header's line and their cells."""
    return markdown.table_rows(_indexed(spark, sf_dir).lines).select("path", F.col("line_no").cast("int").alias("line"), F.col("header_line").cast("int").alias("header_line"), F.array_join("header", ";").alias("header"), F.array_join("cells", ";").alias("cells"))


def shape_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed keywords without one source, or whose source doesn't define them."""
    return gates.registry_issues(_indexed(spark, sf_dir)).select("severity", "path", "line", "rule_code", "message")


QUERIES = {f.__name__: f for f in (shape_bare_paths, shape_link_format, shape_tables, shape_registry)}
_F = f"WITH f AS (SELECT o_orderkey AS k, 'docs/p' || (o_orderkey % 4) || '/d' || o_orderkey || '.md' AS path FROM orders)"
_row = lambda line, message, source: f" SELECT 'ERROR' AS severity, path, CAST({line} AS INTEGER) AS line, 'FMT-FILE-LINK-FORMAT' AS rule_code, {message} AS message FROM {source}"
_bare = lambda line, where="true": _row(line, "path || ': a path without a link'", f"f WHERE {where}")
ORACLE_SQL = {
    "shape_bare_paths": _F + " UNION ALL".join((_bare(3, "k % 3 = 0"), _bare(5, "k % 2 = 1"), _bare(11), _bare(18, "k % 7 <> 0"), _bare(20), )),
    "shape_link_format": _F + ", l AS (SELECT f.*, g.k IS NOT NULL AS there FROM f LEFT JOIN f g ON g.k = f.k + 4)" + " UNION ALL".join((
        _row(2, "'/docs/p0/d.md: an absolute path'", "l WHERE k % 5 = 0"), _row(2, "'../p1/d' || k || '.md: a path that climbs folders'", "l WHERE k % 5 = 1"),
        _row(2, "'d' || (k + 4) || '.md: a path from the document''s folder'", "l WHERE k % 5 = 2 AND there"), _row(2, "path || ': a label other than the file''s name'", "l WHERE k % 5 = 4"),
        _row(11, "path || ': a label other than the file''s name'", "l"))),
}
_R = """WITH f AS (SELECT o_orderkey AS k, 'docs/q' || (o_orderkey % 4) || '/r' || o_orderkey || '.md' AS path, 'docs/q' || ((o_orderkey + 1) % 4) || '/r' || (o_orderkey + 1) || '.md' AS other FROM orders)"""
ORACLE_SQL |= {
    "shape_tables": _R + """ SELECT path, CAST(7 AS INTEGER) AS line, CAST(5 AS INTEGER) AS header_line, 'Keyword;Note;Source' AS header, '{REG_' || k || '};x;[r' || k || '.md](' || path || ')' AS cells FROM f
        UNION ALL SELECT path, 8, 5, 'Keyword;Note;Source', '`{REG_' || (k + 1) || '}` | or;;' || CASE k % 3 WHEN 0 THEN 'a/b.md, c/d.md' WHEN 1 THEN '' ELSE other END FROM f""",
    "shape_registry": _R + """ SELECT 'ERROR' AS severity, path, CAST(8 AS INTEGER) AS line, 'TRACE-INVALID-INDEX-LOCATION' AS rule_code, 'Not one path: the source of REG_' || (k + 1) AS message FROM f WHERE k % 3 < 2
        UNION ALL SELECT 'ERROR', path, 1, 'TRACE-INDEX-WITHOUT-DEFINITION', 'Indexed here, but not defined: REG_' || k FROM (SELECT k, path FROM f WHERE k % 4 <> 0
        UNION SELECT k + 1, other FROM f WHERE k % 3 = 2 AND ((k + 1) % 4 <> 0 OR (k + 1) NOT IN (SELECT k FROM f)))""",
}


def _labelled(spark: SparkSession, sf_dir: str) -> blocks.Corpus:
    """A file docs/l<k % 3>/s<k>.md for each order, with underlined headings and links by label."""
    lines = (
        "'Title of ' || k", "IF(k % 2 = 0, '  second line', '> quoted')", "'==='", "''", "'Links: [other][O' || k || '] and [o  ' || k || '] or [missing].'", "IF(k % 3 = 0, '---', '-- -')", "'- item'", "'lazy'", "'---'", "''",
        "'[O' || k || ']: docs/l' || ((k + 1) % 3) || '/s' || (k + 1) || '.md#top'", "'[o' || k || ']: other.md'", "'[O ' || k || ']: none.md'", "'# ATX'", "'end [O' || k || '][]'",
    )
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return blocks.Corpus(rows.selectExpr("'docs/l' || (k % 3) || '/s' || k || '.md' AS path", f"concat_ws('\n', {', '.join(lines)}) AS content"), [])


def shape_underlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that begin at underlined headings or others; quotations and list items have none."""
    found = _labelled(spark, sf_dir).sections
    return found.select("section_id", "heading", "level", *(F.col(x).cast("int").alias(x) for x in ("line_start", "line_end", "parent_start")))


def shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by label with the line that defines each; of equal labels the first counts."""
    found = blocks.reference_links(_labelled(spark, sf_dir).blocks)
    return found.select("path", "label", "target", "anchor", *(F.col(x).cast("int").alias(x) for x in ("line_no", "defined_at")))


def shape_broken_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by label whose target is missing."""
    return gates.broken_links(_labelled(spark, sf_dir)).select("severity", "path", "line", "rule_code", "message")


QUERIES |= {f.__name__: f for f in (shape_underlined, shape_labels, shape_broken_labels)}
_B = "WITH f AS (SELECT o_orderkey AS k, 'docs/l' || (o_orderkey % 3) || '/s' || o_orderkey || '.md' AS path, 'docs/l' || ((o_orderkey + 1) % 3) || '/s' || (o_orderkey + 1) || '.md' AS other FROM orders)"
_LABELS = _B + """, l AS (SELECT k, path, 'other' AS label, other AS target, 'top' AS anchor, CAST(5 AS INTEGER) AS line_no, CAST(11 AS INTEGER) AS defined_at FROM f
    UNION ALL SELECT k, path, 'o  ' || k, 'none.md', '', 5, 13 FROM f UNION ALL SELECT k, path, 'O' || k, other, 'top', 15, 11 FROM f)"""
ORACLE_SQL |= {
    "shape_underlined": _B + """, s AS (SELECT path, CASE WHEN k % 2 = 0 THEN 'Title of ' || k || ' second line' ELSE '(Overview)' END AS heading, 1 AS level, 1 AS line_start, CASE WHEN k % 3 = 0 THEN 4 ELSE 13 END AS line_end, NULL AS parent_start FROM f
        UNION ALL SELECT path, 'Links: [other][O' || k || '] and [o  ' || k || '] or [missing].', 2, 5, 13, 1 FROM f WHERE k % 3 = 0 UNION ALL SELECT path, 'ATX', 1, 14, 15, NULL FROM f)
        SELECT 'sec:' || path || '#' || heading AS section_id, heading, CAST(level AS INTEGER) AS level, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(parent_start AS INTEGER) AS parent_start FROM s""",
    "shape_labels": _LABELS + " SELECT path, label, target, anchor, line_no, defined_at FROM l",
    "shape_broken_labels": _LABELS + " SELECT 'ERROR' AS severity, path, line_no AS line, 'FMT-BROKEN-LINK' AS rule_code, 'Link target is missing: ' || target AS message FROM l WHERE target = 'none.md' OR k + 1 NOT IN (SELECT k FROM f)",
}
