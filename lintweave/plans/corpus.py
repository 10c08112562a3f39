"""Markdown operators and gates on a corpus made from the orders: a file for each, built by expressions.

The SQL doesn't read the files' text; it says from the orders' numbers what must be found in them. With k an order's
number, its file docs/t<k % 3>/o<k>.md has the lines that ``files`` lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.cli import graph_edges
from lintweave.operators import drift, evidence, gates, invariants, markdown
from lintweave.sources.tables import dealt, table

TIERS = [("^docs/t0/", "0"), ("^docs/t1/", "1"), ("^docs/t2/", "2")]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of each order."""
    lines = (
        "'# Order ' || k",
        "IF(k % 2 = 0, 'The order {ORD_' || k || '} is ours.', 'The order is ours.')",
        # every sixteenth file defines the keyword of the one before it
        "IF(k % 4 < 2, '<!-- definition: {ORD_' || (k - IF(k % 16 = 1, 1, 0)) || '} -->', 'No definition.')",
        "IF(k % 8 = 0, '<!-- traceability: {ORD_' || k || '} -->', 'It needs {ORD_' || (k + 4) || '}.')",
        "'## Links'",
        "'[' || IF(k % 7 = 0, 'see', 'o' || (k + 5) || '.md') || '](docs/t' || ((k + 5) % 3) || '/o' || (k + 5) || '.md#' || IF(k % 10 = 0, 'missing', 'order-' || (k + 5)) || ')'",
        "'```text'",
        "'# Hidden {HID_' || k || '}'",
        "'```'",
        "'## Trace'",
        "IF(k % 5 = 0, '<!-- traceability: none -->', '<!-- traceability: {ORD_' || (k - 1) || '} -->')",
        "IF(k % 6 = 0, '{VERIFY_FORMAL}', 'LIMIT_' || (k div 40) || ' = ' || CASE WHEN k % 40 = 5 THEN '17 us' WHEN k % 20 = 3 THEN '2.0 KB' WHEN k % 2 = 0 THEN '0x8_00U' ELSE '2048' END)",
        "IF(k % 12 = 0, '<!-- evidence: formal=models/' || IF(k % 24 = 12, 'none', 'm') || k || '.py -->', 'See models/m' || k || '.py and https://x.org/m.py for it.')",
        "IF(k % 9 = 0, '```mermaid\\n```', NULL)",
    )
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return rows.select(F.expr("'docs/t' || (k % 3) || '/o' || k || '.md'").alias("path"), F.concat_ws("\n", *(F.expr(x) for x in lines)).alias("content"))


def corpus(spark: SparkSession, sf_dir: str) -> gates.Corpus:
    """The files; of the models that they name, those of every fourth order exist."""
    models = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.expr("'models/m' || o_orderkey || '.py'").alias("path"))
    return gates.Corpus(files(spark, sf_dir), TIERS, models)


def md_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, component, hash and tags of each file."""
    return corpus(spark, sf_dir).documents.withColumn("tags", F.array_join("tags", ","))


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their ends and parents; headings in fences are none."""
    return corpus(spark, sf_dir).sections


def md_line_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each section: those in fences, and all."""
    c = corpus(spark, sf_dir)
    placed = markdown.with_section(c.lines.select("path", "line_no", "inside", "is_fence"), c.sections)
    return placed.groupBy("section_id", "line_start").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("inside")).alias("n_inside"), F.count_if(F.col("is_fence")).alias("n_fences"))


def md_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by section and kind."""
    return corpus(spark, sf_dir).keywords


def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the file that each leads to, empty if none."""
    return corpus(spark, sf_dir).links.select("path", "line_no", "label", "target", "anchor", F.coalesce("key", F.lit("")).alias("key"))


def md_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that files declare."""
    return markdown.evidence(files(spark, sf_dir))


def md_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the knowledge graph."""
    return graph_edges(corpus(spark, sf_dir))


def _gate(check) -> tuple:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(corpus(spark, sf_dir)).select("severity", "path", "line", "rule_code", "message")

    run.__doc__ = check.__doc__
    return run


def md_stale(c: gates.Corpus) -> DataFrame:
    """Lines that match one of two forbidden patterns."""
    return gates.stale_values(c, [("S1", r"needs \{ORD_[0-9]*7\}", "seven"), ("S2", r"^No def", "none")])


INVARIANTS = [
    invariants.Rule("I1", (r"needs \{ORD_\d*7\}", r"o[0-9]*3\.md"), ("docs/t1/*", "docs/t0/o1*"), ("docs/t?/o*4.md",), "ORD_1", "moved"),
    invariants.Rule("I2", ("^No def", "(?i)LINKS$"), ("*5.md",)),
    invariants.Rule("I3", ("LIMIT_[0-9]+ = (17|2)",), (), ("docs/t[02]/*",), None, "old limits"),
    invariants.Rule("I4", ("nowhere at all",)),
]


def md_invariants(c: gates.Corpus) -> DataFrame:
    """Lines that hold what invariants forbid in their files: globs, exclusions, several patterns, one that ignores case."""
    return gates.stale_values(c, INVARIANTS)


def md_drift(c: gates.Corpus) -> DataFrame:
    """Limits with several values."""
    return drift.symbol_drift(c, [r"LIMIT_[0-9]+"])


def md_benchmark(c: gates.Corpus) -> DataFrame:
    """Files with the tag whose evidence isn't a script that exists."""
    return evidence.benchmark_missing(c, tag="VERIFY_FORMAL", key="formal", folder="bench")


_GATES = {
    "md_broken_links": gates.broken_links, "md_broken_anchors": gates.broken_anchors, "md_link_format": gates.file_link_format, "md_empty_mermaid": gates.empty_mermaid,
    "md_undefined": gates.undefined_keywords, "md_overlap": gates.defined_and_referred, "md_unreferenced": gates.unreferenced_requirements, "md_no_marker": gates.definitions_without_marker,
    "md_duplicate_definitions": gates.duplicate_definitions, "md_reverse_links": gates.reverse_links, "md_reverse_keywords": gates.reverse_keywords, "md_missing_evidence": gates.missing_evidence,
    "md_stale": md_stale, "md_invariants": md_invariants, "md_drift": md_drift, "md_benchmark": md_benchmark, "md_dangling": evidence.dangling_artifacts,
}


def md_check_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all gates by rule."""
    found = gates.run_checks(corpus(spark, sf_dir), more={"stale": md_stale, "drift": md_drift, "benchmark": md_benchmark, "dangling": evidence.dangling_artifacts})
    return found.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("f")).select("rule_code", "severity", "n", F.col("f.path").alias("first_path"), F.col("f.line").alias("first_line"))


def md_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run of three gates, and its exit code."""
    return gates.summary(gates.run_checks(corpus(spark, sf_dir), ["broken_links", "empty_mermaid", "defined_and_referred"]))


QUERIES = {f.__name__: f for f in (md_documents, md_sections, md_line_section, md_keywords, md_links, md_evidence, md_graph, md_check_doc, md_exit)} | {k: _gate(f) for k, f in _GATES.items()}

_F = """f AS (SELECT o_orderkey AS k, 'docs/t' || (o_orderkey % 3) || '/o' || o_orderkey || '.md' AS path, o_orderkey % 3 AS tier, CASE WHEN o_orderkey % 9 = 0 THEN 15 ELSE 13 END AS last FROM orders)"""
_S = _F + """, s AS (SELECT k, path, 'Order ' || k AS heading, 1 AS level, 1 AS line_start, 4 AS line_end, NULL AS parent_start FROM f
    UNION ALL SELECT k, path, 'Links', 2, 5, 9, 1 FROM f UNION ALL SELECT k, path, 'Trace', 2, 10, last, 1 FROM f)"""
_K = _F + """, d AS (SELECT k, path, tier, 'sec:' || path || '#Order ' || k AS section_id, 'ORD_' || (k - CASE WHEN k % 16 = 1 THEN 1 ELSE 0 END) AS keyword FROM f WHERE k % 4 < 2),
    one AS (SELECT k, path, 'sec:' || path || '#Order ' || k AS section_id FROM f), three AS (SELECT k, path, 'sec:' || path || '#Trace' AS section_id FROM f WHERE k % 5 <> 0),
    w AS (SELECT path, section_id, 1 AS line_start, 'ORD_' || k AS keyword, 'mention' AS kind FROM one WHERE k % 2 = 0
        UNION SELECT path, section_id, 1, keyword, 'mention' FROM d
        UNION SELECT path, section_id, 1, 'ORD_' || (CASE WHEN k % 8 = 0 THEN k ELSE k + 4 END), 'mention' FROM one
        UNION SELECT path, section_id, 1, 'ORD_' || k, 'inline' FROM one WHERE k % 2 = 0
        UNION SELECT path, section_id, 1, 'ORD_' || (k + 4), 'inline' FROM one WHERE k % 8 <> 0
        UNION SELECT path, section_id, 1, keyword, 'defined' FROM d
        UNION SELECT path, section_id, 1, 'ORD_' || k, 'traced' FROM one WHERE k % 8 = 0
        UNION SELECT path, section_id, 10, 'ORD_' || (k - 1), 'mention' FROM three UNION SELECT path, section_id, 10, 'ORD_' || (k - 1), 'traced' FROM three)"""
_L = _F + """, l AS (SELECT f.*, CASE WHEN f.k % 7 = 0 THEN 'see' ELSE 'o' || (f.k + 5) || '.md' END AS label, 'docs/t' || ((f.k + 5) % 3) || '/o' || (f.k + 5) || '.md' AS target,
    CASE WHEN f.k % 10 = 0 THEN 'missing' ELSE 'order-' || (f.k + 5) END AS anchor, coalesce(g.path, '') AS key, g.tier AS key_tier FROM f LEFT JOIN f g ON g.k = f.k + 5)"""
_issue = lambda severity, rule, line, message, source: f" SELECT '{severity}' AS severity, path, CAST({line} AS INTEGER) AS line, '{rule}' AS rule_code, {message} AS message FROM {source}"
_RULES = {
    "md_broken_links": (_L, _issue("ERROR", "FMT-BROKEN-LINK", 6, "'Link target is missing: ' || target", "l WHERE key = ''")),
    "md_broken_anchors": (_L, _issue("ERROR", "FMT-BROKEN-ANCHOR", 6, "'No heading for anchor: ' || target || '#' || anchor", "l WHERE key <> '' AND anchor = 'missing'")),
    "md_link_format": (_L, _issue("ERROR", "FMT-FILE-LINK-FORMAT", 6, "target || ': a label other than the file''s name'", "l WHERE k % 7 = 0")),
    "md_empty_mermaid": (_F, _issue("WARNING", "FMT-EMPTY-MERMAID", 14, "'Empty diagram'", "f WHERE k % 9 = 0")),
    "md_undefined": (_K, _issue("ERROR", "TRACE-UNDEFINED-KEYWORD", "line_start", "'Undefined keyword: ' || keyword", "w WHERE kind = 'mention' AND keyword NOT IN (SELECT keyword FROM d)")),
    "md_overlap": (_K, _issue("ERROR", "TRACE-DUPLICATE-DEF-REF", 1, "'Defined and referred to in one section: ORD_' || k", "f WHERE k % 8 = 0")),
    "md_unreferenced": (_K, _issue("ERROR", "TRACE-UNREFERENCED-REQUIREMENT", 1, "'Never referred to: ' || keyword", """(SELECT keyword, min(path) AS path FROM d WHERE tier = 0 GROUP BY keyword)
        WHERE keyword NOT IN (SELECT keyword FROM w WHERE kind IN ('mention', 'traced') AND (path, section_id, keyword) NOT IN (SELECT (path, section_id, keyword) FROM d))""")),
    "md_no_marker": (_K, _issue("ERROR", "TRACE-DEFINITION-WITHOUT-INLINE-MARKER", 1, "'No marker in the text: ' || keyword", "d WHERE k % 4 = 1")),
    "md_duplicate_definitions": (_K, _issue("ERROR", "CONSIST-DUPLICATE-DEFINITION", 1, "'Defined again: ' || keyword", "(SELECT keyword, max(path) AS path FROM d GROUP BY keyword HAVING count(*) = 2)")),
    "md_reverse_links": (_L, _issue("ERROR", "HIERARCHY-REVERSE-DEPENDENCY", 6, "'Link to a lower tier: ' || key", "l WHERE tier < key_tier")),
    "md_reverse_keywords": (_K, _issue("ERROR", "HIERARCHY-REVERSE-KEYWORD-REF", "line_start", "'Defined in a lower tier: ' || keyword",
        "(SELECT w.path, w.line_start, w.keyword FROM w JOIN f ON f.path = w.path JOIN (SELECT keyword, arg_min(tier, path) AS u FROM d GROUP BY keyword) x ON x.keyword = w.keyword WHERE kind = 'traced' AND f.tier < x.u)")),
    "md_missing_evidence": (_F, _issue("ERROR", "EVID-FORMAL-UNDECLARED", 1, "'VERIFY_FORMAL without evidence'", "f WHERE k % 12 = 6")
        + " UNION ALL" + _issue("ERROR", "EVID-DECLARED-FILE-MISSING", 1, "'Missing: models/none' || k || '.py'", "f WHERE k % 24 = 12")),
    "md_stale": (_F, _issue("ERROR", "CONSIST-STALE-VALUE", 4, "'S1: seven'", "f WHERE k % 8 <> 0 AND (k + 4) % 10 = 7") + " UNION ALL" + _issue("ERROR", "CONSIST-STALE-VALUE", 3, "'S2: none'", "f WHERE k % 4 >= 2")),
    "md_drift": (_F + """, v AS (SELECT k // 40 AS symbol, CASE WHEN k % 40 = 5 THEN '17us' ELSE '2048' END AS value, path || ':12' AS place FROM f WHERE k % 6 <> 0),
        p AS (SELECT symbol, value, list_sort(list(place)) AS places FROM v GROUP BY ALL),
        m AS (SELECT symbol, string_agg(value || ' @ ' || array_to_string(places[1:3], ', '), '; ' ORDER BY value) AS said, min(places[1]) AS first, count(*) AS n FROM p GROUP BY symbol HAVING count(*) > 1),
        x AS (SELECT symbol, said, replace(first, ':12', '') AS path FROM m)""", _issue("ERROR", "CONSIST-SYMBOL-DRIFT", 12, "'LIMIT_' || symbol || ' has several values: ' || said", "x")),
    "md_benchmark": (_F, _issue("ERROR", "EVID-BENCHMARK-MISSING", 1, "'VERIFY_FORMAL without a script that exists'", "f WHERE k % 12 = 6 OR k % 24 = 12")),
    "md_dangling": (_L, _issue("ERROR", "EVID-DANGLING-ARTIFACT-REF", 13, "'Missing: models/m' || k || '.py'", "f WHERE k % 4 <> 0") + " UNION ALL"
        + _issue("ERROR", "EVID-DANGLING-ARTIFACT-REF", 6, "'Missing: ' || target", "l WHERE key = ''") + " UNION ALL" + _issue("ERROR", "EVID-DANGLING-ARTIFACT-REF", 6, "'Missing: ' || label", "l WHERE key = '' AND k % 7 <> 0") + " UNION ALL"
        + _issue("ERROR", "EVID-DANGLING-ARTIFACT-REF", 13, "'Missing: models/none' || k || '.py'", "f WHERE k % 24 = 12")),
}
_ALL = " UNION ALL ".join(f"SELECT * FROM (WITH {w} {q})" for w, q in _RULES.values())
ORACLE_SQL = {k: f"WITH {w} {q}" for k, (w, q) in _RULES.items()} | {
    "md_documents": f"""WITH {_F}, t AS (SELECT path, tier, 'docs' AS component, k % 6 = 0 AS tagged, concat_ws(chr(10), '# Order ' || k, CASE WHEN k % 2 = 0 THEN 'The order {{ORD_' || k || '}} is ours.' ELSE 'The order is ours.' END,
        CASE WHEN k % 4 < 2 THEN '<!-- definition: {{ORD_' || (k - CASE WHEN k % 16 = 1 THEN 1 ELSE 0 END) || '}} -->' ELSE 'No definition.' END,
        CASE WHEN k % 8 = 0 THEN '<!-- traceability: {{ORD_' || k || '}} -->' ELSE 'It needs {{ORD_' || (k + 4) || '}}.' END, '## Links',
        '[' || CASE WHEN k % 7 = 0 THEN 'see' ELSE 'o' || (k + 5) || '.md' END || '](docs/t' || ((k + 5) % 3) || '/o' || (k + 5) || '.md#' || CASE WHEN k % 10 = 0 THEN 'missing' ELSE 'order-' || (k + 5) END || ')',
        '```text', '# Hidden {{HID_' || k || '}}', '```', '## Trace', CASE WHEN k % 5 = 0 THEN '<!-- traceability: none -->' ELSE '<!-- traceability: {{ORD_' || (k - 1) || '}} -->' END,
        CASE WHEN k % 6 = 0 THEN '{{VERIFY_FORMAL}}' ELSE 'LIMIT_' || (k // 40) || ' = ' || CASE WHEN k % 40 = 5 THEN '17 us' WHEN k % 20 = 3 THEN '2.0 KB' WHEN k % 2 = 0 THEN '0x8_00U' ELSE '2048' END END,
        CASE WHEN k % 12 = 0 THEN '<!-- evidence: formal=models/' || CASE WHEN k % 24 = 12 THEN 'none' ELSE 'm' END || k || '.py -->' ELSE 'See models/m' || k || '.py and https://x.org/m.py for it.' END,
        CASE WHEN k % 9 = 0 THEN '```mermaid' || chr(10) || '```' END) AS text FROM f)
        SELECT path, CAST(tier AS VARCHAR) AS tier, CAST(tier AS INTEGER) AS tier_num, component, sha256(text) AS content_hash, CASE WHEN tagged THEN 'VERIFY_FORMAL' ELSE '' END AS tags FROM t""",
    "md_sections": f"WITH {_S} SELECT path, 'sec:' || path || '#' || heading AS section_id, heading, CAST(level AS INTEGER) AS level, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(parent_start AS INTEGER) AS parent_start FROM s",
    "md_line_section": f"""WITH {_S} SELECT 'sec:' || path || '#' || heading AS section_id, CAST(line_start AS INTEGER) AS line_start, CAST(line_end - line_start + 1 AS BIGINT) AS n_lines,
        CAST(CASE line_start WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS n_inside, CAST(CASE WHEN line_start = 5 OR line_end = 15 THEN 2 ELSE 0 END AS BIGINT) AS n_fences FROM s""",
    "md_keywords": f"WITH {_K} SELECT path, section_id, CAST(line_start AS INTEGER) AS line_start, keyword, kind FROM w",
    "md_links": f"WITH {_L} SELECT path, CAST(6 AS INTEGER) AS line_no, label, target, anchor, key FROM l",
    "md_evidence": f"WITH {_F} SELECT path, 'formal' AS key, 'models/' || CASE WHEN k % 24 = 12 THEN 'none' ELSE 'm' END || k || '.py' AS value FROM f WHERE k % 12 = 0",
    "md_graph": f"""WITH {_K}, s AS (SELECT path, 'sec:' || path || '#' || unnest(['Order ' || k, 'Links', 'Trace']) AS section_id FROM f)
        SELECT path AS source, section_id AS target, 'contains' AS relation FROM s UNION SELECT section_id, 'item:' || keyword, CASE kind WHEN 'defined' THEN 'defines' ELSE 'refers_to' END FROM w WHERE kind IN ('defined', 'traced')
        UNION SELECT 'sec:' || f.path || '#Links', g.path, 'links_to' FROM f JOIN f g ON g.k = f.k + 5""",
    "md_check_doc": f"SELECT rule_code, severity, count(*) AS n, arg_min(path, (path, line)) AS first_path, arg_min(line, (path, line)) AS first_line FROM ({_ALL}) GROUP BY ALL",
    "md_exit": f"WITH {_L} SELECT count(*) FILTER (key = '') + count(*) FILTER (k % 8 = 0) AS errors, count(*) FILTER (k % 9 = 0) AS warnings, CAST(0 AS BIGINT) AS infos, CAST(1 AS INTEGER) AS exit_code FROM l",
}
# the text's lines and the rules' patterns, globs as LIKE
_TEXT = ORACLE_SQL["md_documents"].split("k % 6 = 0 AS tagged, ")[1].split(" AS text FROM f")[0]
ORACLE_SQL["md_invariants"] = (
    f"WITH {_F}, x AS (SELECT path, string_split({_TEXT}, chr(10)) AS ls FROM f), l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM x), m AS ("
    + r"""SELECT path, n, '[I1] superseded: needs \{ORD_\d*7\}, in its place: ORD_1 (moved)' AS message FROM l WHERE regexp_matches(line, 'needs \{ORD_[0-9]*7\}') AND (path LIKE 'docs/t1/%' OR path LIKE 'docs/t0/o1%') AND path NOT LIKE 'docs/t_/o%4.md'
    UNION ALL SELECT path, n, '[I1] superseded: o[0-9]*3\.md, in its place: ORD_1 (moved)' FROM l WHERE regexp_matches(line, 'o[0-9]*3\.md') AND (path LIKE 'docs/t1/%' OR path LIKE 'docs/t0/o1%') AND path NOT LIKE 'docs/t_/o%4.md'
    UNION ALL SELECT path, n, '[I2] superseded: ^No def' FROM l WHERE starts_with(line, 'No def') AND path LIKE '%5.md' UNION ALL SELECT path, n, '[I2] superseded: (?i)LINKS$' FROM l WHERE lower(line) LIKE '%links' AND path LIKE '%5.md'
    UNION ALL SELECT path, n, 'I3: old limits' FROM l WHERE regexp_matches(line, 'LIMIT_[0-9]+ = (17|2)') AND path NOT LIKE 'docs/t0/%' AND path NOT LIKE 'docs/t2/%')"""
    + _issue("ERROR", "CONSIST-STALE-VALUE", "n", "message", "m")
)
