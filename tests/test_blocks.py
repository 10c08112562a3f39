"""Underlined headings and links by label against a loop over lines."""

import random
import re

import pytest

from lintweave.operators import blocks, markdown

POOL = ["text", "  more", "===", "---", "-", "= =", "", "# H", "> quote", "- item", "1. one", "    code", "```", "* * *", "[a]: x.md", "a | b", "	tab", "   ==  "]


def by_hand(text):
    """Headings of a file, with the lines of the open paragraph as a list."""
    out, own, lazy, fence = set(), [], False, False
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip().startswith("```"):
            fence, own, lazy = not fence, [], False
        elif fence or not line.strip() or re.match(r" {0,3}#", line) or re.fullmatch(r"(\* ?){3,}", line):
            own, lazy = [], False
        elif re.fullmatch(r" {0,3}(=+|-+) *", line) and own:
            out.add((own[0][0], n, " ".join(x for _, x in own), 1 if "=" in line else 2))
            own = []
        elif re.fullmatch(r"-+", line):
            own, lazy = [], False
        elif re.match(r"> |- |1\. ", line):
            own, lazy = [], True
        elif lazy or (not own and (re.match(r"    |\t", line) or line.startswith("[a]:"))):
            pass
        else:
            own.append((n, line.strip()))
    return out


@pytest.mark.parametrize("piece", [2, 1024])
def test_underlined(spark, piece):
    rng = random.Random(piece)
    files = {f"f{i}": "\n".join(rng.choice(POOL) for _ in range(rng.randrange(1, 25))).rstrip("\n") for i in range(900)}
    rows = markdown.lines(spark.createDataFrame([*files.items(), ("none", None), ("empty", "")], "path string, content string"))
    got = {(r.path, r.line_start, r.line_end, r.heading, r.level) for r in blocks.underlined(blocks.placed(rows, piece)).collect()}
    want = {(p, *x) for p, t in files.items() for x in by_hand(t)}
    assert got == want and len(want) > 300


def test_reference_links(spark):
    text = "\n".join([
        "see [One  Two][The Label], [the  label][], [plain], ![no][plain] and `[plain]`", "[none] [a](b.md) [x][none] [plain](c.md)", "[inside]: para.md", "", "[the label]: <docs/a%20b.md#top> \"Title\"", "[THE LABEL]: second.md",
        "[plain]: ../p.md", "[web]: https://x.org", "", "[web] [inside] [plain]: [Plain]", "```", "[plain]", "[late]: late.md", "```", "> [plain]", "    [plain]", "", "    [plain]",
    ])
    rows = markdown.lines(spark.createDataFrame([("f", text), ("g", "[plain]"), ("n", None)], "path string, content string"))
    got = sorted(tuple(r)[1:] for r in blocks.reference_links(blocks.placed(rows)).collect())
    to = ("../p.md", "", 7)
    assert got == sorted([(1, "One  Two", "docs/a b.md", "top", 5), (1, "the  label", "docs/a b.md", "top", 5), (1, "plain", *to), (10, "Plain", *to), (15, "plain", *to), (16, "plain", *to)])
