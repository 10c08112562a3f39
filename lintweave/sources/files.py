"""File sources: texts of a folder as rows of (path, content)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as an anchored Java pattern: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$"


def excluded(path: str, globs: list[str]):
    """Whether a path (column name) or its base name matches one of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | F.col(path).rlike(glob_regex(g)) | F.substring_index(path, "/", -1).rlike(glob_regex(g))
    return out


def read_texts(spark: SparkSession, root: str, glob: str = "*.md", exclude: list[str] | None = None) -> DataFrame:
    """(path, content) of the files under root whose name matches glob; path is relative to root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    named = rows.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("content"))
    return named.filter(~excluded("path", exclude)) if exclude else named


def _relative(root: str, at: str = "_metadata.file_path") -> Column:
    """A file's path from root on. An expression of the file's metadata alone, so that a filter on it chooses files before any is read."""
    # a plus is itself in a path, but a blank to url_decode
    path = F.url_decode(F.replace(F.regexp_replace(at, "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + re.sub("^[a-z0-9]+:/*", "", root.rstrip("/")).lstrip("/")
    # the last place where root ends: a scheme's authority may come before it
    return F.regexp_replace(path, f"^.*?{re.escape(base)}/", "")


def chosen(path: Column, include: list[str], exclude: list[str] = (), patterns: list[str] = ()) -> Column:
    """Whether one of the globs matches the path and nothing excludes it.

    An exclusion matches the whole path or the file's name; in it * crosses folders. A pattern is a regular expression that is
    searched in the path. No globs choose nothing.
    """
    name = F.substring_index(path, "/", -1)
    wide = [glob_regex(re.sub(r"\*+/?", lambda m: "**/" if m[0] == "**/" else "**", g)) for g in exclude]
    no = [path.rlike(g) | name.rlike(g) for g in wide] + [path.rlike(p) for p in patterns]
    return reduce(or_, (path.rlike(glob_regex(g)) for g in include), F.lit(False)) & ~reduce(or_, no, F.lit(False))


def _scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], patterns: list[str], only: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The chosen files as a scan gives them, and the paths of those that are empty: Spark's scans leave empty files out."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def mine(rows: DataFrame, path: Column) -> DataFrame:
        rows = rows.filter(chosen(path, include, exclude, patterns))
        return (rows if only is None else rows.filter(path.isin(list(only)))).withColumn("_at", path)

    scanned = mine(every, _relative(root))
    # the names that the scan's own listing holds; they go from it to the tasks without a pass through Python
    jvm = spark.sparkContext._jvm
    names = DataFrame(spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(every._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    return scanned, mine(names, _relative(root, "value")).select("_at").join(scanned.select("_at"), "_at", "left_anti")


def list_files(spark: SparkSession, root: str, include: list[str] = ("**",), exclude: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """(path, size) of the files under root that the union of globs chooses, empty ones too; no content is read."""
    scanned, empty = _scan(spark, root, include, exclude, patterns, None)
    return scanned.select(F.col("_at").alias("path"), F.col("length").alias("size")).unionByName(empty.select(F.col("_at").alias("path"), F.lit(0).cast("long").alias("size")))


def read_files(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), patterns: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """(path, size, content) of the chosen files, each once however many globs match it; content is null if it isn't UTF-8.

    Files that aren't chosen are neither opened nor given to a task. ``only`` further narrows them to a list of paths. Names
    that begin with a dot or an underscore are hidden, and so is what lies in such folders.
    """
    scanned, empty = _scan(spark, root, include, exclude, patterns, only)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = scanned.select(F.col("_at").alias("path"), F.col("length").alias("size"), text.alias("content"))
    return read.unionByName(empty.select(F.col("_at").alias("path"), F.lit(0).cast("long").alias("size"), F.lit("").alias("content")))
