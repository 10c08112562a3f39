"""Operator 4: personal data, also where it is disguised.

Base matches are those of four patterns on the text as it is. Then a transducer rewrites the text (homoglyphs, full-width
forms and other scripts' digits to ASCII; invisible characters to nothing; runs of spelled digits to digits; at and dot
disguises to signs) and notes for each character it writes the source characters it stands for. Matches in the
rewritten text whose source is written otherwise are mapped back to source offsets and added, unless a base span of
their kind contains them; base spans all stay.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can't begin inside a run of digits: where the run's start fails, its other digits fail too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "ɡ": "g", "ɑ": "a", "ı": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "·": ".", "•": ".",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Names of digits.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_NAME = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
# three names of digits at least, or one beside digits
_SPELLED = re.compile(rf"(?i)\b{_NAME}(?:[\s,.-]{{0,2}}\b{_NAME}\b){{2,}}|(?<=[0-9][ -]){_NAME}\b|\b{_NAME}(?=[ -][0-9])")
_NAMES = re.compile(rf"(?i)\b{_NAME}\b")
_TRIGGER = re.compile(r"(?i)[\[({<]\s{0,3}(?:at|@|dot|\.|punkt|punto|point)\s{0,3}[\])}>]|\b(?:at|dot|punkt|punto|point)\b")
_SIGN_AT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]\s{0,3}")
_SIGN_DOT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|punto|point)\s{0,3}[\])}>]\s{0,3}")
_WORD_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s{1,3}(?:dot|punkt|punto|point)\s{1,3}(?=[A-Za-z0-9])")
# a spelled "at" counts only where a spelled or bracketed dot follows its domain
_WORD_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}\x00)")


@lru_cache(maxsize=1)
def _glyphs() -> dict[int, str]:
    """By code point: the ASCII character that a single other character stands for."""
    found = {}
    for c in range(0x80, 0x1FBFA):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch)
        digit = unicodedata.decimal(ch, None)
        if digit is not None:
            found[c] = str(digit)
        elif len(plain) == 1 and plain.isascii():
            found[c] = plain
    return found | {ord(k): v for k, v in _LOOKALIKES.items()}


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, in linear time: before each @ the run of local characters is taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(d) // 5 + int(d) * 2 % 10 for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The patterns' matches by kind, leftmost and non-overlapping; those that fail their test are dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for x in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


class Rewritten:
    """A text and, for each of its characters, the start and end of the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Rewrites the ranges, in order, to the given strings."""
        if not found:
            return
        texts, starts, ends, at = [], [], [], 0
        for s, e, new in found:
            texts += [self.text[at:s], new]
            starts += [*self.starts[at:s], *[self.starts[s]] * len(new)]
            ends += [*self.ends[at:s], *[self.ends[e - 1]] * len(new)]
            at = e
        self.text = "".join([*texts, self.text[at:]])
        self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]


def rewrite(text: str) -> Rewritten | None:
    """The transducers' output, or None if they leave the text as it is."""
    out = Rewritten(text.translate(_glyphs())) if not text.isascii() else Rewritten(text)
    out.replace([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", out.text)] if not text.isascii() else [])
    if _NAMES.search(out.text):
        found = []
        for m in _SPELLED.finditer(out.text):
            last = m.start()
            for d in _NAMES.finditer(out.text, m.start(), m.end()):
                found.append((last, d.end(), _DIGITS[d[0].lower()]))
                last = d.end()
        out.replace(found)
        # what joins a spelled digit to others is kept as it is
    if _TRIGGER.search(out.text):
        out.replace([(m.start(), m.end(), "@") for m in _SIGN_AT.finditer(out.text)])
        out.replace([(m.start(), m.end(), "\x00") for m in _SIGN_DOT.finditer(out.text)])
        out.replace([(m.start(), m.end(), "\x00") for m in _WORD_DOT.finditer(out.text)])
        out.replace([(m.start(), m.end(), "@") for m in _WORD_AT.finditer(out.text)])
        out.text = out.text.replace("\x00", ".") if "\x00" not in text else out.text
    return None if out.text == text else out


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each as (kind, start, end) by kind, then start."""
    base = find(text)
    more = {k: list(v) for k, v in base.items()}
    if out := rewrite(text):
        for kind, found in find(out.text).items():
            for s, e in found:
                a, b = out.starts[s], out.ends[e - 1]
                if text[a:b] != out.text[s:e] and not any(x <= a and b <= y for x, y in base[kind]):
                    more[kind].append((a, b))
    order = lambda by: [(k, s, e) for k in KINDS for s, e in sorted(by[k])]
    return order(base), order(more)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base and all: array of struct(kind, start, end)); no shuffle."""
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                both = [spans(x) for x in texts]
                cols = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in b[i]] for b in both], row) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "base", "all"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, f"doc_id {kind}, base {each}, all {each}")


def masked(text: str) -> str:
    """The text with each stretch of found spans replaced by the kind of its first one in capitals, in angle brackets."""
    out, at, last = [], 0, -1
    for s, e, kind in sorted((s, -e, k) for k, s, e in spans(text)[1]):
        e = -e
        if s < last:
            at = last = max(last, e)
            continue
        out += [text[at:s], f"<{kind.upper()}>"]
        at = last = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in its text column; all columns and rows stay, a null text stays null."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for part, texts in slices(batch, text_col):
                new = pa.array([masked(x) for x in texts], pa.string())
                new = pc.if_else(part.column(i).is_null(), pa.scalar(None, pa.string()), new)
                yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(part.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the base spans (n_email and so on), and all spans."""
    found = detect(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        *(count(F.col("all"), k).alias(f"n_{k}_all") for k in KINDS),
    )
