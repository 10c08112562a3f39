"""Headings and links that take more than their own line: underlined headings, links by label.

Whether a line is in a paragraph depends on the lines before it; the states (none, a paragraph, a quotation's or a list item's,
which goes on without its mark) follow by composed transition tables, so that a file of very many lines is split.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates, markdown, states
from .lines import grown

#: Codes of lines: one that ends a paragraph, text, an indented line, a mark of a quotation or list, = and - underlines, a definition of a label.
END, TEXT, INDENTED, MARKED, DOUBLE, SINGLE, DEFINITION = range(7)
NONE, OPEN, LAZY = range(3)
#: The state after a line of each code, by the state before it.
TABLE = ((NONE, NONE, NONE), (OPEN, OPEN, LAZY), (NONE, OPEN, LAZY), (LAZY, LAZY, LAZY), (OPEN, NONE, LAZY), (NONE, NONE, NONE), (NONE, OPEN, LAZY))
_DEFINED = r"^ {0,3}\[([^\[\]]*[^\[\]\s][^\[\]]*)\]:[ \t]*<?([^\s<>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$"


def _code() -> Column:
    line = F.regexp_replace("line", r"\r$", "")
    return (
        F.when(F.col("is_fence") | F.col("inside") | line.rlike(r"^\s*$|^ {0,3}#{1,6}(\s|$)"), END)
        .when(line.rlike(r"^ {0,3}=+[ \t]*$"), DOUBLE)
        .when(line.rlike(r"^ {0,3}-+[ \t]*$"), SINGLE)
        .when(line.rlike(r"^ {0,3}(\*[ \t]*){3,}$|^ {0,3}(_[ \t]*){3,}$|^ {0,3}(-[ \t]*){3,}$"), END)
        .when(line.rlike(r"^ {0,3}(>|[-+*][ \t]|[0-9]{1,9}[.)][ \t])"), MARKED)
        .when(line.rlike(r"^( {4}| {0,3}\t)"), INDENTED)
        .when(line.rlike(_DEFINED), DEFINITION)
        .otherwise(TEXT)
    )


def placed(rows: DataFrame, piece: int = states.PIECE) -> DataFrame:
    """rows (path, line_no, line, is_fence, inside) with code and state, the one before each line."""
    coded = rows.withColumn("code", _code())
    return states.run(coded, F.col("code"), TABLE, piece)


def underlined(found: DataFrame) -> DataFrame:
    """(path, line_start, line_end, heading, level) of placed lines: paragraphs that a line of = (1) or - (2) ends.

    A heading's lines are joined by blanks. Lines of quotations, list items, fences and code aren't headings.
    """
    opens = F.col("code").isin(TEXT, DOUBLE) & (F.col("state") == NONE)
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("code").isin(DOUBLE, SINGLE) & (F.col("state") == OPEN)
    lines = found.select("path", "line_no", "line", "code", "state", closes.alias("closes"), F.last(F.when(opens, F.col("line_no")), ignorenulls=True).over(so_far).alias("line_start"))
    ends = lines.filter("closes").select("path", "line_start", F.col("line_no").alias("line_end"), F.when(F.col("code") == DOUBLE, 1).otherwise(2).alias("level"))
    mine = lines.filter(((F.col("state") == OPEN) | (F.col("line_no") == F.col("line_start"))) & ~F.col("closes")).join(grown(ends), ["path", "line_start"]).filter("line_no < line_end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("t")))), lambda x: x["t"]), " ")
    return mine.groupBy("path", "line_start", "line_end", "level").agg(text.alias("heading")).select("path", "line_start", "line_end", "heading", "level")


def _label(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def definitions(found: DataFrame) -> DataFrame:
    """(path, key, to, line_no) of labels that placed lines define, outside paragraphs; the first of a file counts."""
    own = found.filter((F.col("code") == DEFINITION) & (F.col("state") == NONE)).select("path", "line_no", _label(F.regexp_extract("line", _DEFINED, 1)).alias("key"), F.regexp_extract("line", _DEFINED, 2).alias("to"))
    return own.groupBy("path", "key").agg(F.min_by("to", "line_no").alias("to"), F.min("line_no").alias("line_no"))


def reference_links(found: DataFrame) -> DataFrame:
    """(path, line_no, label, target, anchor, defined_at) of links by label in placed lines, [text][label], [label][] or [label]; distinct.

    Without a definition there is no link. Images, code spans, inline links and outer protocols aren't any. line_no is the use's line.
    """
    text = found.filter(~F.col("is_fence") & ~F.col("inside") & ~((F.col("code") == INDENTED) & (F.col("state") == NONE)) & ~((F.col("code") == DEFINITION) & (F.col("state") == NONE)))
    bare = F.regexp_replace("line", "`[^`]*`", "")
    each = text.select("path", "line_no", F.explode(F.regexp_extract_all(bare, F.lit(r"(?<![!\]\\])(\[[^\[\]]+\](?:\[[^\[\]]*\])?)(?![(\[:])"), F.lit(1))).alias("l"))
    label, named = F.regexp_extract("l", r"^\[([^\]]+)\]", 1), F.regexp_extract("l", r"\]\[([^\]]*)\]$", 1)
    used = each.select("path", "line_no", label.alias("label"), _label(F.when(named == "", label).otherwise(named)).alias("key"))
    known = definitions(found).select("path", "key", "to", F.col("line_no").alias("defined_at"))
    to = F.coalesce(F.try_url_decode("to"), "to")
    rows = used.join(grown(known), ["path", "key"]).filter(~F.col("to").rlike("^(https?://|mailto:)"))
    return rows.select("path", "line_no", "label", F.split_part(to, F.lit("#"), F.lit(1)).alias("target"), F.regexp_extract(to, "#(.*)$", 1).alias("anchor"), "defined_at").distinct()


@dataclass
class Corpus(gates.Corpus):
    """A corpus whose sections begin at underlined headings too, and whose links are those by label too."""

    @cached_property
    def blocks(self) -> DataFrame:
        return placed(self.lines)

    @cached_property
    def sections(self) -> DataFrame:
        return markdown.sections(self.lines, underlined(self.blocks))

    def bodies(self) -> DataFrame:
        rows = markdown.with_section(self.lines.select("path", "line_no", "line", "inside", "is_fence"), self.sections).filter("NOT inside AND NOT is_fence")
        # a section is one row: its lines in order
        text = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        return rows.groupBy("path", "line_start").agg(F.array_join(F.transform(text, lambda x: x["line"]), "\n").alias("text"))

    @cached_property
    def keywords(self) -> DataFrame:
        return markdown.keywords(self.lines, self.sections)

    def named(self, *kinds: str) -> DataFrame:
        return self.keywords.filter(F.col("kind").isin(*kinds))

    def found_links(self) -> DataFrame:
        return super().found_links().unionByName(reference_links(self.blocks).drop("defined_at")).distinct()
