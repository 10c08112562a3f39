"""Command line: checks a folder of Markdown files or source files and prints issues.

    python -m lintweave.cli check-doc ROOT [--tier PATTERN=NAME ...] [--exclude GLOB ...] [--exclude-pattern PATTERN ...] [--file PATH ...]
        [--id-glob GLOB ...] [--symbol PATTERN ...] [--stale PATTERN ...]
    python -m lintweave.cli report ROOT (the same options; a Markdown report)
    python -m lintweave.cli check-src ROOT [--namespace NAME]
    python -m lintweave.cli next-id ROOT
    python -m lintweave.cli graph ROOT [--max-nodes N] (a Mermaid diagram)
    python -m lintweave.cli graph-json ROOT
    python -m lintweave.cli build ROOT
    python -m lintweave.cli format-doc ROOT

--file narrows the documents that are checked; identifiers are read from all files that --id-glob chooses, whatever --file says.
The exit code is 1 if there is an issue of severity ERROR.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import code_rules, drift, evidence, formal, gates, graphs, idindex, markdown, report, states, termmine
from lintweave.plans.report import GATES
from lintweave.sources.files import list_files, read_files, read_texts


def _corpus(spark: SparkSession, args: argparse.Namespace) -> gates.Corpus:
    tiers = [tuple(x.rsplit("=", 1)) for x in args.tier]
    root = os.path.abspath(args.root)
    docs = read_files(spark, root, ["**/*.md"], args.exclude, args.exclude_pattern, args.file or None).filter("content IS NOT NULL")
    return gates.Corpus(docs.select("path", "content"), tiers, list_files(spark, root).select("path"))


def _identifiers(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Tokens of all files that the identifier globs choose."""
    files = read_files(spark, os.path.abspath(args.root), args.id_glob or ["**/*.md"], args.exclude, args.exclude_pattern)
    return idindex.tokens(markdown.lines(files.filter("content IS NOT NULL")))


def _unreadable(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """An information for each chosen document that isn't UTF-8; no other check sees it."""
    lost = read_files(spark, os.path.abspath(args.root), ["**/*.md"], args.exclude, args.exclude_pattern, args.file or None).filter("content IS NULL")
    return lost.select(F.lit("Source").alias("gate"), F.lit("INFO").alias("severity"), "path", F.lit(1).alias("line"), F.lit("SRC-NOT-UTF8").alias("rule_code"), F.concat(F.lit("Not UTF-8, "), F.col("size").cast("string"), F.lit(" bytes")).alias("message"))


def _show(rows: DataFrame) -> bool:
    """Prints issues and returns whether one is an error; the listing is what the command is for."""
    found = 0
    for r in rows.toLocalIterator():
        print(*r, sep="\t")
        found += "ERROR" in tuple(r)
    return bool(found)


def graph_edges(c: gates.Corpus) -> DataFrame:
    """(source, target, relation): contains, defines, refers_to and links_to, distinct."""
    if type(c) is gates.Corpus and "sections" not in c.__dict__:
        return _cut_edges(c)
    inside = c.sections.select(F.col("path").alias("source"), F.col("section_id").alias("target"), F.lit("contains").alias("relation"))
    item = F.concat(F.lit("item:"), "keyword")
    kinds = c.keywords.filter("kind IN ('defined', 'traced')")
    named = kinds.select(F.col("section_id").alias("source"), item.alias("target"), F.when(F.col("kind") == "defined", "defines").otherwise("refers_to").alias("relation"))
    at = markdown.with_section(c.links.filter("key IS NOT NULL").select("path", "line_no", "key"), c.sections)
    linked = at.select(F.coalesce("section_id", "path").alias("source"), F.col("key").alias("target"), F.lit("links_to").alias("relation"))
    return inside.unionByName(named).unionByName(linked).distinct()


def _cut_edges(c: gates.Corpus) -> DataFrame:
    """As ``graph_edges`` of sections by ATX headings: files are cut where their rows are, and only links are shuffled."""
    own = markdown.atx_edges(c.files).select("source", "target", "relation")
    # a file's edges are distinct, and all but a link's end begin with its path: only files that share one, or whose
    # sections may be named like another's, can have an edge in common
    shared = F.count(F.lit(1)) > 1
    if c.files.groupBy("path").agg(shared.alias("shared")).filter("shared OR path IS NULL OR path LIKE '%#%' OR path LIKE 'sec:%'").limit(1).count():
        own = own.distinct()
    at = c.keyed(markdown.atx_links(c.files)).filter("key IS NOT NULL")
    linked = at.select(F.coalesce("section_id", "path").alias("source"), F.col("key").alias("target"), F.lit("links_to").alias("relation"))
    return own.unionByName(linked.distinct())


def graph_nodes(c: gates.Corpus) -> DataFrame:
    """(id, ord, type, label): files, then sections, then items."""
    files = c.files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.substring_index("path", "/", -1).alias("label"))
    sections = c.sections.select(F.col("section_id").alias("id"), F.lit("section").alias("type"), F.col("heading").alias("label"))
    items = c.keywords.filter("kind IN ('defined', 'traced')").select(F.concat(F.lit("item:"), "keyword").alias("id"), F.lit("item").alias("type"), F.col("keyword").alias("label"))
    rows = files.unionByName(sections).unionByName(items).dropDuplicates(["id"])
    return rows.select("id", F.array_position(F.array(*map(F.lit, ("file", "section", "item"))), F.col("type")).alias("ord"), "type", "label")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lintweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("check-doc", "check-src", "next-id", "graph", "graph-json", "build", "format-doc", "report"))
    parser.add_argument("root")
    parser.add_argument("--tier", action="append", default=[])
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--exclude-pattern", action="append", default=[], help="a regular expression of paths that are left out")
    parser.add_argument("--file", action="append", default=[], help="a document to check, relative to the root; all without it")
    parser.add_argument("--id-glob", action="append", default=[], help="files that identifiers are read from")
    parser.add_argument("--namespace")
    parser.add_argument("--symbol", action="append", default=[], help="a pattern of symbols whose values must agree")
    parser.add_argument("--stale", action="append", default=[], help="a pattern that no line may match")
    parser.add_argument("--max-nodes", type=int, default=150)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lintweave").getOrCreate()
    if args.command == "check-src":
        root = os.path.abspath(args.root)
        found = code_rules.python_rules(read_texts(spark, root, "*.py", args.exclude))
        cpp = read_texts(spark, root, "*.{c,cc,cpp,h,hpp}", args.exclude)
        return int(_show(found.unionByName(code_rules.cpp_rules(cpp, args.namespace)).orderBy("path", "line", "rule")))
    c = _corpus(spark, args)
    if args.command in ("check-doc", "report"):
        ids = lambda c: idindex.issues(_identifiers(spark, args)).select(F.lit("Identifier").alias("gate"), "severity", "path", "line", "rule_code", F.col("token").alias("message"))
        more = {"identifiers": ids, "bare_paths": states.bare_paths, "benchmark": evidence.benchmark_missing, "artifacts": evidence.dangling_artifacts, "unreadable": lambda c: _unreadable(spark, args)}
        models = formal.scripts(read_files(spark, os.path.abspath(args.root), ["**/formal/*.py"], args.exclude, args.exclude_pattern))
        more["models"] = lambda c: formal.missing_models(c.documents, models)
        if args.symbol:
            more["drift"] = lambda c: drift.symbol_drift(c, args.symbol)
        if args.stale:
            more["stale"] = lambda c: gates.stale_values(c, [(f"S{i + 1}", p, p) for i, p in enumerate(args.stale)])
        found = gates.run_checks(c, more=more).drop("ord")
        if args.command == "report":
            print(report.markdown_report(found, GATES), end="")
            return 0
        return int(_show(found.orderBy("gate", "path", "line", "rule_code", "message")))
    c = c.stored()
    if args.command == "next-id":
        _show(idindex.next_ids(_identifiers(spark, args)).orderBy("family", "series"))
    elif args.command == "graph":
        print("\n".join(graphs.mermaid(graph_nodes(c), graph_edges(c), args.max_nodes)))
    elif args.command == "graph-json":
        for r in graphs.as_json(graph_nodes(c), graph_edges(c)).orderBy("part", "json").toLocalIterator():
            print(r.json)
    elif args.command == "build":
        bodies = markdown.with_section(c.lines.select("path", "line_no", "line"), c.sections).groupBy("path", "section_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        sections = bodies.select("path", F.col("section_id").alias("section"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
        _show(termmine.scored(termmine.candidates(sections), c.documents.count()))
    else:
        clean = F.concat(F.regexp_replace(F.regexp_replace("content", r"(?m)[ \t\r]+$", ""), r"\n*\z", ""), F.lit("\n"))
        for r in c.files.select("path", "content", clean.alias("clean")).filter("content <> clean").toLocalIterator():
            with open(os.path.join(args.root, r.path), "w", encoding="utf-8", newline="") as out:
                out.write(r.clean)
            print(r.path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
