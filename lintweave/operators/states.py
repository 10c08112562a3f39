"""Line states (fences, comments) by composed transition tables.

A line's effect on a state machine is a function of few states. Such functions compose, so a file's lines fall into pieces
of bounded length: each piece becomes one function, the functions of a file's pieces are composed up to each piece, and then
every piece runs from the state that it is entered with. No task holds more of a file than a piece, and one function for
each of its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import cut_names
from .gates import Corpus, _issues, normal_path
from .lines import grown

#: Lines of a piece.
PIECE = 1024


def compose(codes: str, table: Sequence[Sequence[int]]) -> list[int]:
    """Of each state, the one that it becomes over a piece's lines; a line's code is a letter, from a on."""
    out = list(range(len(table[0])))
    for c in codes:
        step = table[ord(c) - 97]
        out = [step[s] for s in out]
    return out


def run(lines: DataFrame, code: Column, table: Sequence[Sequence[int]], piece: int = PIECE, start: int = 0) -> DataFrame:
    """Adds state, the one before each line, to lines (path, line_no, ...); table[code][state] is the state after a line."""
    @F.pandas_udf("array<int>")
    def effect(codes: pd.Series) -> pd.Series:
        return codes.map(lambda x: compose(x, table))

    @F.pandas_udf("array<int>")
    def entered(codes: pd.Series, state: pd.Series) -> pd.Series:
        def each(x: str, s: int) -> list[int]:
            out = []
            for c in x:
                out.append(s)
                s = table[ord(c) - 97][s]
            return out

        return pd.Series([each(x, int(s)) for x, s in zip(codes, state, strict=True)])

    rest = [x for x in lines.columns if x not in ("path", "line_no")]
    own = lines.select("path", F.floor((F.col("line_no") - 1) / piece).alias("piece"), F.struct(F.col("line_no").cast("long").alias("line_no"), F.char(code + 97).alias("_code"), F.struct(*rest).alias("_rest")).alias("_row"))
    # a piece carries its lines, so that no join brings lines and states together
    pieces = own.groupBy("path", "piece").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    pieces = pieces.withColumn("_codes", F.array_join(F.transform("_rows", lambda x: x["_code"]), ""))
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    follow = lambda acc, f: F.get(f, acc)
    entry = F.aggregate(F.coalesce(F.collect_list("_effect").over(before), F.array().cast("array<array<int>>")), F.lit(start), follow)
    known = pieces.withColumn("_effect", effect("_codes")).select("path", "_rows", entered("_codes", entry).alias("_each"))
    each = known.select("path", F.explode(F.arrays_zip("_rows", "_each")).alias("_x"))
    return each.select("path", F.col("_x._rows.line_no").alias("line_no"), *(F.col(f"_x._rows._rest.{x}").alias(x) for x in rest), F.col("_x._each").alias("state"))


#: States of the check of bare paths: in neither, in a fence, in a comment, in a fence that began in a comment.
TEXT, CODE, COMMENT, BOTH = range(4)


def visible(rows: DataFrame) -> DataFrame:
    """Lines (path, line_no, line) of prose: not in ``` fences nor in comments that begin a line, over however many lines.

    A fence line counts within a comment too, and nothing ends a comment within a fence. Lines that begin with a comment, and
    with ---, are left out.
    """
    bare = F.regexp_replace("line", r"(?U)^\s+", "")
    fence, opens, closes = F.startswith(bare, F.lit("```")), F.startswith(bare, F.lit("<!--")), F.contains("line", F.lit("-->"))
    code = F.when(fence, 0).when(opens & closes, 1).when(opens, 2).when(closes, 3).otherwise(4)
    # by code: of TEXT, CODE, COMMENT and BOTH
    table = [[CODE, TEXT, BOTH, COMMENT], [TEXT, CODE, TEXT, BOTH], [COMMENT, CODE, COMMENT, BOTH], [TEXT, CODE, TEXT, BOTH], [TEXT, CODE, COMMENT, BOTH]]
    seen = run(rows.select("path", "line_no", "line"), code, table)
    return seen.filter((F.col("state") == TEXT) & ~fence & ~opens & ~F.startswith(bare, F.lit("---"))).select("path", "line_no", "line")


def masked(line: Column) -> Column:
    """A line whose inline links and anchor tags are blanks."""
    return F.regexp_replace(F.regexp_replace(line, r"\[[^\]]*\]\([^)]*\)", " "), r"(?U)<a\s+[^>]*>", " ")


# Folders in which a path from the root begins.
ROOTS = ("docs", "inc", "src", "tests", "tools", "experiments")


def bare_paths(c: Corpus) -> DataFrame:
    """Issues of files that prose names by their path from the root without a link, if they exist."""
    runs = F.split(masked(F.col("line")), r"(?U)[^\w./\[(-]+")
    each = visible(c.lines).select("path", "line_no", F.posexplode(F.transform(runs, lambda x: F.regexp_replace(x, "^[-.]+(?=[^/.-])", ""))).alias("n", "run"))
    each = each.filter(F.split("run", "/")[0].isin(*ROOTS) & F.contains("run", F.lit("/")))
    named = cut_names(each, "run", lambda word: word.rlike("^[A-Za-z0-9_]+$"))
    named = named.filter(F.col("ref").rlike("^[A-Za-z0-9_./-]+$") & F.col("ref").rlike("^[a-z]+/."))
    inside = F.regexp_replace("ref", "^docs/", "")
    at = F.explode(F.array_distinct(F.array(normal_path(F.col("ref")), normal_path(inside), normal_path(F.concat(F.lit("docs/"), inside)))))
    held = named.select("path", "line_no", "n", "ref", at.alias("at")).join(grown(c.paths.select(F.col("path").alias("at"))), "at").select("path", "line_no", "n", "ref").distinct()
    return _issues(held, "Format", "ERROR", "FMT-FILE-LINK-FORMAT", F.concat("ref", F.lit(": a path without a link")))
