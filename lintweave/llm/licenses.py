"""Operator 3: licence scans by the Dice coefficient over word bigrams.

A text is normalised (lower case, runs of letters and digits as words); so is each template. Dice = 2 * common / (sum of
sizes), of the distinct bigrams of a template and of a stretch of the text's words. All stretches count, wherever they
begin and end; the best one of a template is found exactly. It begins and ends with a bigram of the template, since
others at its ends only lower its score, and from one start it needn't go on beyond the place where its first bigram comes
again, as a later start does as well from there.

Sizes prune templates first: to reach the threshold t, a stretch needs t / (2 - t) of the template's bigrams, so a template
of which the whole text holds fewer goes at once; and a stretch with more than (2 - 2 t) / t times the template's size of
other bigrams is too large.

Each document's result is the best template (ties: the longest stretch, then the name that sorts first), its score, and all templates found with
their places (the first of the best stretches). Templates are a parameter, {name: texts}. Null texts and texts of fewer
than two words have none. Repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, slices

THRESHOLD = 0.8

# Usual notices and short licence texts, by name.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "All rights reserved": ("Copyright. All rights reserved.",),
}
_WORD = re.compile(r"[^\W_]+")
Templates = dict[str, tuple[str, ...]]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """Distinct pairs of neighbours."""
    return set(zip(words, words[1:], strict=False))


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[tuple[str, int]], dict[tuple[str, str], list[int]], set[str]]:
    """Templates as (name, size), the templates of each bigram, and the first words of bigrams."""
    rows = [(name, bigrams(_WORD.findall(t.lower()))) for name, texts in templates for t in texts]
    by: dict[tuple[str, str], list[int]] = {}
    for i, (_, grams) in enumerate(rows):
        for g in grams:
            by.setdefault(g, []).append(i)
    return [(name, len(grams)) for name, grams in rows], by, {g[0] for g in by}


def best_stretch(pairs: list[tuple[str, str]], hits: list[int], size: int, threshold: float) -> tuple[float, int, int] | None:
    """(score, first pair, end) of the best stretch of pairs for a template of that size, whose bigrams stand at hits.

    The first and shortest of those that tie; None below the threshold.
    """
    own, best = set(hits), None
    for k, start in enumerate(hits):
        seen, common, others = set(), 0, 0
        for at in range(start, hits[-1] + 1):
            p = pairs[at]
            if at > start and p == pairs[start]:
                break
            if p in seen:
                continue
            seen.add(p)
            if at not in own:
                others += 1
                # not even all that the template has beside them would do
                if 2 * size < threshold * (2 * size + others) - 1e-9:
                    break
                continue
            common += 1
            score = 2 * common / (size + common + others)
            if score >= threshold and (best is None or score > best[0]):
                best = score, start, at + 1
        if best and best[0] == 1.0:
            break
    return best


def scan_text(text: str, threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> list[tuple[str, float, int, int]]:
    """(licence, score, start, end) of the best stretch for each licence found, by score, then length, then name; places are characters."""
    rows, by, firsts = _index(tuple((k, tuple(v)) for k, v in templates.items()))
    words = _WORD.findall(text.lower())
    hits: dict[int, list[int]] = {}
    kinds: dict[int, set[tuple[str, str]]] = {}
    for k in range(len(words) - 1):
        if words[k] in firsts and (of := by.get(pair := (words[k], words[k + 1]))):
            for i in of:
                hits.setdefault(i, []).append(k)
                kinds.setdefault(i, set()).add(pair)
    enough = [i for i, x in kinds.items() if (2 - threshold) * len(x) >= threshold * rows[i][1] - 1e-9]
    if not enough:
        return []
    pairs = list(zip(words, words[1:], strict=False))
    found: dict[str, tuple[float, int, int]] = {}
    for i in sorted(enough):
        name, size = rows[i]
        got = best_stretch(pairs, hits[i], size, threshold)
        if got and got[0] > found.get(name, (0.0,))[0]:
            found[name] = got
    if not found:
        return []
    # lower case can change a text's length, never its words' order
    at = [m.span() for m in _WORD.finditer(text)]
    if len(at) != len(words):
        at = _spans_of_lowered(text)
    order = sorted(found, key=lambda k: (-found[k][0], found[k][1] - found[k][2], k))
    return [(k, found[k][0], at[found[k][1]][0], at[found[k][2]][1]) for k in order]


def _spans_of_lowered(text: str) -> list[tuple[int, int]]:
    """Places in text of the words of its lower case, character by character."""
    places = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(places[m.start()], places[m.end() - 1] + 1) for m in _WORD.finditer("".join(c.lower() for c in text))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> DataFrame:
    """(doc_id, license, score, n_licenses, found array of struct(license, score, start, end)); no shuffle."""
    each = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                rows = [scan_text(x, threshold, templates) for x in texts]
                cols = [
                    pa.array([r[0][0] if r else None for r in rows], pa.string()),
                    pa.array([round(r[0][1], 6) if r else 0.0 for r in rows], pa.float64()),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([[dict(zip(("license", "score", "start", "end"), x, strict=True)) for x in r] for r in rows], each),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "license", "score", "n_licenses", "found"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, license string, score double, n_licenses long, found array<struct<license:string,score:double,start:bigint,end:bigint>>")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    return scan(documents(spark, sf_dir))
