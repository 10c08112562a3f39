"""Interface files: names and bracket structure of (path, content)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}


def parse(content: str) -> tuple[int | None, str | None, list[str], list[str]]:
    """(line of the first error, its message, interfaces, worlds)."""
    text = _COMMENT.sub(lambda m: "\n" * m[0].count("\n"), content)
    text = text.replace("->", "  ")
    interfaces, worlds = re.findall(r"\binterface\s+([a-z][a-z0-9-]*)\s*\{", text), re.findall(r"\bworld\s+([a-z][a-z0-9-]*)\s*\{", text)
    held: list[tuple[str, int]] = []
    line = 1
    for c in text:
        line += c == "\n"
        if c in "([{<":
            held.append((c, line))
        elif c in _PAIRS:
            if not held or held[-1][0] != _PAIRS[c]:
                return line, f"unexpected {c}", interfaces, worlds
            held.pop()
    if held:
        return held[-1][1], f"unclosed {held[-1][0]}", interfaces, worlds
    if not interfaces and not worlds and "package" not in text:
        return 1, "no package, interface or world", interfaces, worlds
    return None, None, interfaces, worlds


def check(files: DataFrame) -> DataFrame:
    """(path, status, line, message, interfaces, worlds); null contents are empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *parse(c or "")) for p, c in zip(part["path"], part["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["path", "line", "message", "interfaces", "worlds"])
            out["line"] = out["line"].astype("Int32")
            out.insert(1, "status", ["FAIL" if m else "PASS" for m in out["message"]])
            yield out

    return files.filter("endswith(path, '.wit')").select("path", "content").mapInPandas(run, "path string, status string, line int, message string, interfaces array<string>, worlds array<string>")
