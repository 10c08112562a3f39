"""Checks on a Markdown corpus; each returns issues (gate, severity, path, line, rule_code, message)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintweave.functions.text import anchor_slug
from lintweave.sources.work import Work

from . import invariants, markdown, typos
from .lines import grown


def _issues(rows: DataFrame, gate: str, severity: str, rule: str, message: Column, line: str | Column = "line_no") -> DataFrame:
    at = F.col(line) if isinstance(line, str) else line
    return rows.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), "path", at.cast("int").alias("line"), F.lit(rule).alias("rule_code"), message.alias("message"))


def normal_path(path: Column) -> Column:
    """A path without . and resolvable .. parts."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


@dataclass
class Corpus:
    """files (path, content), other existing paths (path), and tiers as (pattern, name) in order."""

    files: DataFrame
    tiers: list[tuple[str, str]]
    existing: DataFrame | None = None

    @cached_property
    def documents(self) -> DataFrame:
        return markdown.documents(self.files, self.tiers)

    @cached_property
    def lines(self) -> DataFrame:
        return markdown.lines(self.files)

    @cached_property
    def prose(self) -> DataFrame:
        return markdown.atx_prose(self.files)

    def bodies(self) -> DataFrame:
        """(path, line_start, text): the sections' lines outside fences."""
        return markdown.atx_texts(self.files)

    @cached_property
    def sections(self) -> DataFrame:
        return markdown.atx_sections(self.files)

    @cached_property
    def keywords(self) -> DataFrame:
        return markdown.atx_keywords(self.files)

    def named(self, *kinds: str) -> DataFrame:
        """The keywords of some kinds; where all aren't known yet, the others aren't looked for."""
        if "keywords" in self.__dict__:
            return self.keywords.filter(F.col("kind").isin(*kinds))
        return markdown.atx_keywords(self.files, kinds)

    def found_links(self) -> DataFrame:
        return markdown.links(self.lines)

    @cached_property
    def links(self) -> DataFrame:
        """With key: the corpus path that the target is, from the root or else from the file's folder."""
        return self.keyed(self.found_links())

    def keyed(self, found: DataFrame) -> DataFrame:
        """Links (path, target, ...) with root_key, own_key and key."""
        folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
        found = found.withColumns({"root_key": normal_path(F.col("target")), "own_key": normal_path(F.concat(folder, "target"))})
        known = self.documents.select(F.col("path").alias("known"))
        by_root = found.join(grown(known.withColumnRenamed("known", "by_root")), F.col("root_key") == F.col("by_root"), "left")
        by_own = by_root.join(grown(known.withColumnRenamed("known", "by_own")), F.col("own_key") == F.col("by_own"), "left")
        key = F.when(F.col("target") == "", F.col("path")).otherwise(F.coalesce("by_root", "by_own"))
        return by_own.withColumn("key", key).drop("by_root", "by_own")

    def stored(self) -> Corpus:
        """The same corpus, its relations written once: for runs of many checks, which would each parse the files again."""
        work = Work(self.files.sparkSession, "corpus")
        out = type(self)(self.files, self.tiers, self.existing)
        for name in ("documents", "lines", "prose", "sections", "keywords", "links", "paths"):
            # each is computed from those before it as they were written
            out.__dict__[name] = work.put(getattr(out, name))
        return out

    @cached_property
    def paths(self) -> DataFrame:
        mine = self.files.select("path")
        return (mine.unionByName(self.existing.select("path")) if self.existing else mine).distinct()


def broken_links(c: Corpus) -> DataFrame:
    """Targets that are neither in the corpus nor among the existing paths."""
    found = c.links.filter("target <> '' AND key IS NULL")
    for k in ("root_key", "own_key"):
        found = found.join(grown(c.paths.select(F.col("path").alias(k))), k, "left_anti")
    return _issues(found, "Format", "ERROR", "FMT-BROKEN-LINK", F.concat(F.lit("Link target is missing: "), "target"))


def broken_anchors(c: Corpus) -> DataFrame:
    """Anchors without a heading of that form in a target that exists."""
    heads = c.sections.select(F.col("path").alias("key"), F.explode(F.array(anchor_slug(F.col("heading")), "heading")).alias("slug")).distinct()
    asked = c.links.filter("anchor <> '' AND key IS NOT NULL").withColumn("slug", anchor_slug(F.col("anchor")))
    missing = asked.join(grown(heads), ["key", "slug"], "left_anti")
    return _issues(missing, "Format", "ERROR", "FMT-BROKEN-ANCHOR", F.concat(F.lit("No heading for anchor: "), "target", F.lit("#"), "anchor"))


def file_link_format(c: Corpus) -> DataFrame:
    """Links that are absolute, climb folders, or whose label isn't the file's name."""
    target, base = F.col("target"), F.substring_index("target", "/", -1)
    named = F.regexp_replace(F.regexp_replace("label", r"(?U)^\s*`*|`*\s*$", ""), "[#:].*$", "")
    why = (
        F.when(target.rlike(r"^(file:|/|\\|[A-Za-z]:)"), "an absolute path")
        .when(target.rlike(r"^\.\.[/\\]|/\.\./"), "a path that climbs folders")
        .when(F.col("root_key") != F.coalesce("key", "root_key"), "a path from the document's folder")
        .when(named != base, "a label other than the file's name")
    )
    return _issues(c.links.filter("target <> ''").withColumn("why", why).filter("why IS NOT NULL"), "Format", "ERROR", "FMT-FILE-LINK-FORMAT", F.concat("target", F.lit(": "), "why"))


def empty_mermaid(c: Corpus) -> DataFrame:
    """Mermaid blocks without content."""
    return _issues(markdown.mermaid(c.lines).filter("trim(body) = ''"), "Format", "WARNING", "FMT-EMPTY-MERMAID", F.lit("Empty diagram"))


def _defined(c: Corpus) -> DataFrame:
    return c.named("defined")


def undefined_keywords(c: Corpus) -> DataFrame:
    """Mentions, outside the sections that define them, of keywords that nothing defines."""
    own = _defined(c)
    found = c.named("mention").join(grown(own), ["path", "section_id", "keyword"], "left_anti").join(grown(own.select("keyword").distinct()), "keyword", "left_anti")
    return _issues(found, "Traceability", "ERROR", "TRACE-UNDEFINED-KEYWORD", F.concat(F.lit("Undefined keyword: "), "keyword"), "line_start")


def defined_and_referred(c: Corpus) -> DataFrame:
    """Keywords that one section both defines and traces."""
    found = _defined(c).join(grown(c.named("traced").select("path", "section_id", "keyword")), ["path", "section_id", "keyword"], "left_semi")
    return _issues(found, "Traceability", "ERROR", "TRACE-DUPLICATE-DEF-REF", F.concat(F.lit("Defined and referred to in one section: "), "keyword"), "line_start")


def unreferenced_requirements(c: Corpus) -> DataFrame:
    """Keywords that tier 0 defines and no other section mentions or traces; for the first file that defines them."""
    own = _defined(c)
    top = own.join(grown(c.documents.filter("tier_num = 0").select("path")), "path", "left_semi")
    first = top.groupBy("keyword").agg(F.min(F.struct("path", "line_start")).alias("at")).select("keyword", "at.*")
    used = c.named("mention", "traced").join(grown(own), ["path", "section_id", "keyword"], "left_anti")
    return _issues(first.join(grown(used.select("keyword").distinct()), "keyword", "left_anti"), "Traceability", "ERROR", "TRACE-UNREFERENCED-REQUIREMENT", F.concat(F.lit("Never referred to: "), "keyword"), F.lit(1))


def definitions_without_marker(c: Corpus) -> DataFrame:
    """Definition comments whose keyword the section's text doesn't hold."""
    found = _defined(c).join(grown(c.named("inline")), ["path", "section_id", "keyword"], "left_anti")
    return _issues(found, "Traceability", "ERROR", "TRACE-DEFINITION-WITHOUT-INLINE-MARKER", F.concat(F.lit("No marker in the text: "), "keyword"), "line_start")


def duplicate_definitions(c: Corpus) -> DataFrame:
    """Keywords with two definitions or more; at the second."""
    # two minima, each pre-aggregated, in place of a rank within a keyword that many files may define
    at = F.struct("path", "line_start")
    first = _defined(c).groupBy("keyword").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = _defined(c).join(grown(first), "keyword").filter(at > F.col("first")).groupBy("keyword").agg(F.min(at).alias("at"))
    return _issues(later.select("keyword", "at.*"), "Consistency", "ERROR", "CONSIST-DUPLICATE-DEFINITION", F.concat(F.lit("Defined again: "), "keyword"), "line_start")


def reverse_links(c: Corpus) -> DataFrame:
    """Links from a tier to one below it."""
    tier = c.documents.filter("tier_num IS NOT NULL")
    own = c.links.join(grown(tier.select("path", F.col("tier_num").alias("t"))), "path").join(grown(tier.select(F.col("path").alias("key"), F.col("tier_num").alias("u"))), "key")
    return _issues(own.filter("t < u"), "Hierarchy", "ERROR", "HIERARCHY-REVERSE-DEPENDENCY", F.concat(F.lit("Link to a lower tier: "), "key"))


def reverse_keywords(c: Corpus, exempt: tuple[str, ...] = ("META_", "GLOBAL_")) -> DataFrame:
    """Traced keywords whose first definition is in a lower tier."""
    tier = c.documents.filter("tier_num IS NOT NULL").select("path", "tier_num")
    first = _defined(c).join(grown(c.documents.select("path", "tier_num")), "path", "left").groupBy("keyword").agg(F.min_by("tier_num", F.struct("path", "line_start")).alias("u"))
    found = c.named("traced").join(grown(tier), "path").join(grown(first), "keyword").filter("tier_num < u")
    for p in exempt:
        found = found.filter(~F.startswith("keyword", F.lit(p)))
    return _issues(found, "Hierarchy", "ERROR", "HIERARCHY-REVERSE-KEYWORD-REF", F.concat(F.lit("Defined in a lower tier: "), "keyword"), "line_start")


def missing_evidence(c: Corpus) -> DataFrame:
    """Verification tags without an evidence key, and declared paths that don't exist."""
    keys = {"VERIFY_FORMAL": "formal", "VERIFY_WIT": "wit", "VERIFY_BENCHMARK": "benchmark"}
    declared = markdown.evidence(c.files)
    parts = []
    for tag, key in keys.items():
        tagged = c.documents.filter(F.array_contains("tags", tag)).select("path", F.lit(1).alias("line_no"))
        parts.append(_issues(tagged.join(grown(declared.filter(F.col("key") == key)), "path", "left_anti"), "Evidence", "ERROR", f"EVID-{key.upper()}-UNDECLARED", F.lit(f"{tag} without evidence")))
    gone = declared.filter("key <> 'contract-only'").withColumn("key_path", normal_path(F.col("value"))).join(grown(c.paths.select(F.col("path").alias("key_path"))), "key_path", "left_anti")
    return reduce(DataFrame.unionByName, [*parts, _issues(gone, "Evidence", "ERROR", "EVID-DECLARED-FILE-MISSING", F.concat(F.lit("Missing: "), "value"), F.lit(1))])


def stale_values(c: Corpus, rules: list) -> DataFrame:
    """Lines that hold what an invariant forbids in their file: rules are invariants, or (id, pattern, reason) for all files."""
    known = [r if isinstance(r, invariants.Rule) else invariants.Rule(r[0], (r[1],), reason=r[2]) for r in rules]
    return _issues(invariants.violations(c.files, known), "Consistency", "ERROR", "CONSIST-STALE-VALUE", invariants.said(known), "line")


def registry(c: Corpus, keyword: str = "Keyword", source: str = "Source") -> DataFrame:
    """(keyword, source, path, line_no) of tables that index keywords; source is null unless the cell names one path."""
    rows = markdown.table_rows(c.lines).withColumns({"k": F.array_position("header", keyword).cast("int"), "s": F.array_position("header", source).cast("int")}).filter("k > 0 AND s > 0")
    named = rows.withColumn("keyword", F.regexp_extract(F.coalesce(F.try_element_at("cells", F.col("k")), F.lit("")), r"\{([A-Za-z0-9_-]+)\}", 1)).filter("keyword <> ''")
    cell = F.regexp_replace(F.coalesce(F.try_element_at("cells", F.col("s")), F.lit("")), r"\[[^\]]*\]\(([^)#]*)[^)]*\)", "$1")
    paths = F.array_distinct(F.filter(F.split(F.replace(cell, F.lit("`"), F.lit("")), r"[,;\s]+"), lambda x: x != ""))
    return named.select("keyword", F.when(F.size(paths) == 1, paths[0]).alias("source"), "path", "line_no")


def registry_issues(c: Corpus, index: DataFrame | None = None) -> DataFrame:
    """Indexed keywords (keyword, source, path, line_no) whose source isn't one path, or whose source doesn't define them."""
    index = registry(c) if index is None else index
    lost = _issues(index.filter("source IS NULL"), "Traceability", "ERROR", "TRACE-INVALID-INDEX-LOCATION", F.concat(F.lit("Not one path: the source of "), "keyword"))
    defined = _defined(c).select(F.col("path").alias("source"), "keyword").distinct()
    bare = index.filter("source IS NOT NULL").join(grown(defined), ["source", "keyword"], "left_anti").select("keyword", F.col("source").alias("path")).distinct()
    return lost.unionByName(_issues(bare, "Traceability", "ERROR", "TRACE-INDEX-WITHOUT-DEFINITION", F.concat(F.lit("Indexed here, but not defined: "), "keyword"), F.lit(1)))


def typo_variants(c: Corpus, most: int = 50) -> DataFrame:
    """Words that may be misspelled forms of others: the first pairs of Katakana words and of English ones."""
    parts = []
    for found in (typos.katakana_found(c.bodies(), most), typos.english_found(c.bodies(), most)):
        said = F.concat(F.lit("May be a variant: "), "word", F.lit(" and "), "other", F.lit(" ("), "other_path", F.lit(":"), F.col("other_line").cast("string"), F.lit(")"))
        parts.append(_issues(found, "Format", "WARNING", "FMT-LEVENSHTEIN-TYPO", said, "line_start"))
    return parts[0].unionByName(parts[1])


CHECKS = {
    f.__name__: f
    for f in (
        broken_links, broken_anchors, file_link_format, empty_mermaid, undefined_keywords, defined_and_referred, unreferenced_requirements,
        definitions_without_marker, duplicate_definitions, reverse_links, reverse_keywords, missing_evidence, typo_variants, registry_issues,
    )
}


def run_checks(c: Corpus, names: list[str] | None = None, more: dict | None = None) -> DataFrame:
    """The issues of all checks, or of the named ones, in order; more adds checks of one's own, corpus to issues."""
    known = CHECKS | (more or {})
    c = c.stored()
    work = Work(c.files.sparkSession, "issues")
    # a job for each check, so that no plan grows with their number
    chosen = [work.put(known[n](c).withColumn("ord", F.lit(i))) for i, n in enumerate(names or known)]
    return reduce(DataFrame.unionByName, chosen)


def summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos and the exit code (1 on any error)."""
    counts = [F.count_if(F.col("severity") == s).alias(k) for s, k in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))]
    return issues.agg(*counts).withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))
