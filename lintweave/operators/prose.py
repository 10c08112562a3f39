"""Prose blocks of Markdown and readability candidates, with an injected sentence splitter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_JAPANESE = re.compile(r"[ぁ-ゖァ-ヺ一-龯]")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})(.*)$")
_SENTENCE = re.compile(r"[^。！？!?]+[。！？!?]?")


def blocks(content: str) -> list[tuple[int, str]]:
    """(line, text) of paragraphs, list items, quotes and table cells that hold Japanese; no front matter, fences or comments."""
    out: list[tuple[int, list[str]]] = []
    fence, comment, open_block = "", False, False
    lines = content.split("\n")
    start = 0
    if lines and lines[0].strip() == "---":
        start = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    for i, line in enumerate(lines[start:], start + 1):
        mark = _FENCE.match(line)
        if fence:
            # a fence closes with the same sign, at least as many of them and nothing after
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
            open_block = False
            continue
        if mark and not comment:
            fence, open_block = mark[1], False
            continue
        text = ""
        while line:
            if comment:
                _, closed, line = line.partition("-->")
                comment = not closed
            else:
                plain, opened, line = line.partition("<!--")
                text, comment = text + plain, bool(opened)
        text = text.strip()
        if not text or re.match(r"#{1,6}\s|[-*_]{3,}$|\|?[\s:|-]+\|?$", text):
            open_block = False
        elif text.startswith("|"):
            out += [(i, [cell.strip()]) for cell in text.strip("|").split("|")]
            open_block = False
        else:
            item = re.match(r"(?:[-*+]|\d+[.)])\s+|>\s*", text)
            text = text[item.end() :] if item else text
            if open_block and not item:
                out[-1][1].append(text)
            else:
                out.append((i, [text]))
            open_block = True
    joined = [(i, " ".join(x)) for i, x in out]
    return [(i, x) for i, x in joined if _JAPANESE.search(x)]


def split(text: str) -> list[str]:
    """Sentences by their end signs."""
    return [x.strip() for x in _SENTENCE.findall(text) if x.strip()]


def candidates(files: DataFrame, most: int = 100, splitter: Callable[[str], list[str]] = split) -> DataFrame:
    """(path, line, sentence, n_chars) of sentences with more characters than `most`, white space aside."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, i, s, n) for p, c in zip(part["path"], part["content"], strict=True) for i, b in blocks(c or "") for s in splitter(b) if (n := len(re.sub(r"\s", "", s))) > most]
            yield pd.DataFrame(rows, columns=["path", "line", "sentence", "n_chars"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, sentence string, n_chars int")
