"""Identifier index of a corpus: definitions, references and ranges of declared families.

A family is (name, pattern) with the named groups of Java patterns: serial, and others that form the series. Definitions
stand in the first cell of a table row within a second-level section headed `2`, or begin a heading; every other full
token is a reference; two tokens joined by `..` are a range. Lines come from ``markdown.lines``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import expand_ranges

# The families, each with its series and its serial.
FAMILIES = {
    "TEST": r"TEST-([A-Z]+)-([0-9]{2,})",
    "GOTCHA": r"GOTCHA-([A-Z]+)-([0-9]{2,})",
    "BENCHMARK": r"BENCH-([A-Z]+)-([0-9]{2,})",
    "FORMAL": r"FORMAL-([A-Z]+)-([0-9]{2,})",
    "ADR": r"ADR-()([0-9]{3,})",
}
_ANY = r"\b(?:TEST|GOTCHA|BENCH|FORMAL|ADR)(?:-[A-Za-z0-9]+)+(?:\.\.(?:TEST|GOTCHA|BENCH|FORMAL|ADR)(?:-[A-Za-z0-9]+)+)?"


def _parsed(token: Column) -> Column:
    """struct(family, series, serial) or null."""
    out = F.lit(None).cast("struct<family:string,series:string,serial:int>")
    for name, p in FAMILIES.items():
        made = F.struct(F.lit(name).alias("family"), F.regexp_extract(token, p, 1).alias("series"), F.regexp_extract(token, p, 2).try_cast("int").alias("serial"))
        out = F.when(token.rlike(f"^{p}$"), made).otherwise(out)
    return out


def tokens(rows: DataFrame) -> DataFrame:
    """(path, line_no, pos, token, until, kind): kind is definition, reference, range or invalid; until ends a range."""
    ordered = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    second = F.when(F.col("line").rlike(r"^##\s") & ~F.col("inside"), F.col("line").rlike(r"^##\s+2\b"))
    marked = rows.withColumn("in_two", F.coalesce(F.last(second, ignorenulls=True).over(ordered), F.lit(False))).filter("NOT inside AND NOT is_fence")
    cell = F.regexp_extract("line", r"^\s*\|\s*[*`]*([^|*`\s]+)[*`]*\s*\|", 1)
    head = F.regexp_extract("line", r"^#{1,6}\s+(ADR-[0-9]+)\b", 1)
    own = F.when(F.col("in_two") & (cell != ""), cell).when(head != "", head)
    each = marked.select("path", "line_no", own.alias("own"), F.posexplode(F.regexp_extract_all("line", F.lit(f"({_ANY})"), F.lit(1))).alias("pos", "found"))
    parts = each.select("path", "line_no", "pos", "own", F.split_part("found", F.lit(".."), F.lit(1)).alias("token"), F.nullif(F.split_part("found", F.lit(".."), F.lit(2)), F.lit("")).alias("until"))
    a, b = _parsed(F.col("token")), _parsed(F.col("until"))
    bad = a.isNull() | (F.col("until").isNotNull() & (b.isNull() | (a["series"] != b["series"]) | (a["family"] != b["family"])))
    kind = F.when(bad, "invalid").when((F.col("pos") == 0) & (F.col("own") == F.col("token")) & F.col("until").isNull(), "definition").when(F.col("until").isNotNull(), "range").otherwise("reference")
    return parts.select("path", "line_no", "pos", "token", "until", kind.alias("kind"), a.alias("id"), b["serial"].alias("last"))


def definitions(found: DataFrame) -> DataFrame:
    """(token, family, series, serial, path, line_no)."""
    return found.filter("kind = 'definition'").select("token", "id.*", "path", "line_no")


def expanded(found: DataFrame) -> DataFrame:
    """(path, line_no, token): references, and those of ranges to what is defined in them."""
    defined = definitions(found).select("family", "series", "serial", "token").distinct()
    ranges = found.filter("kind = 'range' AND id.serial <= last").select("path", "line_no", "id.family", "id.series", F.col("id.serial").alias("low"), F.col("last").alias("high"))
    inside = expand_ranges(ranges, defined, 16, ("family", "series")).select("path", "line_no", "token")
    return found.filter("kind = 'reference'").select("path", "line_no", "token").unionByName(inside)


def next_ids(found: DataFrame) -> DataFrame:
    """(family, series, next_id): the largest serial and one, padded as the largest is."""
    top = definitions(found).groupBy("family", "series").agg(F.max("serial").alias("n"), F.max_by(F.length(F.regexp_extract("token", "([0-9]+)$", 1)), "serial").alias("width"))
    n = (F.col("n") + 1).cast("string")
    return top.select("family", "series", F.lpad(n, F.greatest(F.lit(2), F.col("width"), F.length(n)), F.lit("0")).alias("next_id"))


def issues(found: DataFrame) -> DataFrame:
    """(severity, rule_code, path, line, token) of all identifier checks."""
    defined = definitions(found)
    row = lambda df, severity, rule, token="token": df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_code"), "path", F.col("line_no").alias("line"), F.col(token).alias("token"))
    twice = defined.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("n > 1")
    ends = found.filter("kind IN ('reference', 'range')").select("path", "line_no", F.explode(F.array_compact(F.array("token", "until"))).alias("token"))
    open_ends = ends.join(defined.select("token"), "token", "left_anti")
    used = expanded(found).select("token").unionByName(ends.select("token"))
    unused = defined.filter("family IN ('TEST', 'GOTCHA', 'BENCHMARK')").join(used, "token", "left_anti")
    gaps = defined.groupBy("family", "series").agg(F.min("path").alias("path"), F.lit(1).alias("line_no"), (F.max("serial") - F.min("serial") + 1 - F.countDistinct("serial")).alias("n"))
    gaps = gaps.filter("n > 0").withColumn("token", F.concat_ws("-", "family", "series"))
    parts = [
        row(found.filter("kind = 'invalid'"), "ERROR", "ID-INVALID-FORMAT"), row(found.filter("kind = 'range' AND id.serial > last"), "ERROR", "ID-INVALID-RANGE"),
        row(twice, "ERROR", "ID-DUPLICATE-DEFINITION"), row(open_ends, "ERROR", "ID-UNRESOLVED-REFERENCE"), row(unused, "WARNING", "ID-UNREFERENCED-DEFINITION"), row(gaps, "INFO", "ID-SERIAL-GAPS"),
    ]
    return reduce(DataFrame.unionByName, parts)
