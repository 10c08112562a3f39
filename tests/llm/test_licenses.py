"""Licence headers of one family that differ in a word or a version."""

import pytest

import random

from lintweave.llm import licenses


@pytest.mark.parametrize(
    ("what", "name", "version", "license"),
    [("program", "Affero General", "3", "AGPL-3.0"), ("program", "Lesser General", "3", "LGPL-3.0"), ("library", "Lesser General", "2.1", "LGPL-2.1"), ("program", "General", "2", "GPL-2.0"), ("program", "General", "3", "GPL-3.0")],
)
def test_family(what, name, version, license):
    text = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    assert licenses.scan_text(f"Before it.\n\n{text}\n\nAfter it.")[0][0] == license


def best_by_hand(words, grams, threshold):
    """The best score of all stretches of words."""
    best = 0.0
    for a in range(len(words) - 1):
        seen = set()
        for b in range(a + 1, len(words)):
            seen.add((words[b - 1], words[b]))
            best = max(best, 2 * len(seen & grams) / (len(seen) + len(grams)))
    return best if best >= threshold else 0.0


def test_all_stretches():
    """Every stretch of random texts that hold parts of templates, against brute force."""
    rnd = random.Random(4)
    templates = {"one": ("a b c d e f g h",), "two": ("a b a c a d", "h g f e d c b a h c"), "three": ("x y z x y w v u t s",)}
    grams = {k: [licenses.bigrams(t.split()) for t in v] for k, v in templates.items()}
    hits = 0
    for _ in range(1500):
        words = []
        while len(words) < rnd.randrange(1, 40):
            own = rnd.choice(rnd.choice(list(templates.values()))).split()
            a = rnd.randrange(len(own))
            words += own[a : a + rnd.randrange(1, 12)] + rnd.choices("abcdxyz", k=rnd.randrange(3))
            if rnd.random() < 0.3:
                words[rnd.randrange(len(words))] = "q"
        text, threshold = " ".join(words), rnd.choice((0.6, 0.8, 0.95))
        got = licenses.scan_text(text, threshold, templates)
        want = {k: max(best_by_hand(words, g, threshold) for g in own) for k, own in grams.items()}
        assert {name: round(score, 9) for name, score, _, _ in got} == {k: round(v, 9) for k, v in want.items() if v}
        for name, score, s, e in got:
            part = licenses.bigrams(text[s:e].split())
            assert max(2 * len(part & g) / (len(part) + len(g)) for g in grams[name]) == score
            hits += 1
    assert hits > 500


def test_inside_sentences():
    for text in (
        "our work is now licensed under the GNU General Public License, version 3. ok good",
        "alpha beta gamma delta work is licensed under the GNU General Public License version 3 epsilon epsilon zeta",
        "İİ intro\nThis work is licensed under the\nGNU General Public License, version 3.",
    ):
        name, score, s, e = licenses.scan_text(text)[0]
        assert name == "GPL-3.0" and score >= 0.8 and text[s:e].lower().endswith("version 3"), (name, score, text[s:e])
    assert licenses.scan_text(" ".join(licenses.TEMPLATES["BSD-3-Clause"]))[0][:2] == ("BSD-3-Clause", 1.0)
    assert licenses.scan_text("word") == [] and licenses.scan_text("") == []
