"""Named groups of source files: which groups a name means, and which files a group holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import glob_regex

# Names that stand for several groups, and what the groups' names must have.
ALIASES = {"python": ("prefix", "python_"), "concept": ("part", "concept"), "concepts": ("part", "concept"), "formal": ("part", "formal"), "model": ("part", "formal"), "pysim": ("part", "pysim"), "sim": ("part", "pysim")}


@dataclass(frozen=True)
class Group:
    """Folders, endings (with the dot) and file name patterns; empty ones don't restrict."""

    folders: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


def resolve(groups: dict[str, Group], name: str | None = None) -> list[str]:
    """The groups that a name means: all, an alias, the group itself, or those whose names hold it."""
    asked = (name or "all").lower()
    if asked in ("all", "*"):
        return list(groups)
    if asked in ALIASES:
        how, what = ALIASES[asked]
        return [g for g in groups if (g.startswith(what) if how == "prefix" else what in g)]
    return [asked] if asked in groups else [g for g in groups if asked in g]


def of_group(files: DataFrame, group: Group, explicit: list[str] | None = None) -> DataFrame:
    """The rows of files (path, ...) that a group holds, one for each path; explicit paths restrict them further."""
    base = F.substring_index("path", "/", -1)
    rows = files
    if group.folders:
        rows = rows.filter(F.greatest(*(F.startswith("path", F.lit(f.rstrip("/") + "/")) for f in group.folders), F.lit(False)))
    if group.endings:
        rows = rows.filter(F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)).isin(*(e.lower() for e in group.endings)))
    if group.patterns:
        rows = rows.filter(F.greatest(*(base.rlike(glob_regex(p)) for p in group.patterns), F.lit(False)))
    if explicit is not None:
        rows = rows.filter(F.col("path").isin(*explicit) if explicit else F.lit(False))
    return rows.dropDuplicates(["path"])
