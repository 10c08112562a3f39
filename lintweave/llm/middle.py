"""Operator 12: fill-in-the-middle transformation by succinct rank and select.

A text's units are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`. Whitespace and the rest are told apart by
single bytes of UTF-8, so a unit ends where a byte that isn't whitespace stands before one that is, and at the text's end.
These ends are the set bits of a packed bitvector over the bytes of a slice of texts, with a directory of popcounts by
block. The popcount between a text's first and last byte is its number of units; select on two ranks gives the two byte
cuts; a second bitvector, of first bytes of code points, turns cuts into lengths by rank. No list of units is ever made:
memory is two bits a byte, and temporary arrays of CHUNK bytes.

Each row is judged alone, there is no shuffle. A null text is empty and stays plain; a null id counts as no digits after
`42:`. Rows that repeat an id and text repeat their result. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are transformed; of 100 of them, those whose suffix comes first.
MIDDLE_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Bytes that are looked at at once while bitvectors are packed; a multiple of 64.
CHUNK = 1 << 22
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Bits:
    """A packed bitvector with the number of set bits before each block; rank and select take arrays."""

    def __init__(self, packed: np.ndarray):
        """packed: bytes, the lowest bit first."""
        room = 8 * BLOCK * (len(packed) // (8 * BLOCK) + 1)  # a last block is never full, so that rank may ask for the end
        self.words = np.concatenate([packed, np.zeros(room - len(packed), np.uint8)]).view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, block = at >> 6, at // (64 * BLOCK)
        out = self.before[block].copy()
        for j in range(BLOCK - 1):
            inner = block * BLOCK + j
            out += np.where(inner < word, np.bitwise_count(self.words[inner]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of each k-th set bit, from 0; k is less than the number of set bits."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        sums = np.cumsum(np.bitwise_count(self.words[block[:, None] * BLOCK + np.arange(BLOCK)]), axis=1, dtype=np.int64)
        j = (sums <= left[:, None]).sum(axis=1)
        left = left - np.where(j > 0, sums[np.arange(len(k)), np.maximum(j - 1, 0)], 0)
        word, place = self.words[block * BLOCK + j], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            upper = left >= n
            left = left - np.where(upper, n, 0)
            word = np.where(upper, word >> np.uint64(width), low)
            place += np.where(upper, width, 0)
        return (block * BLOCK + j) * 64 + place


def bitvectors(data: np.ndarray, ends: np.ndarray) -> tuple[Bits, Bits]:
    """Of the last bytes of units, and of the first bytes of code points; ends: one past each text's last byte in data."""
    units, points = [], []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        space = _SPACE[part]
        after = _SPACE[data[at + len(part)]] if at + len(part) < len(data) else True
        last = ~space & np.append(space[1:], after)
        own = ends[(ends > at) & (ends <= at + len(part))] - 1 - at
        last[own] = True
        units.append(np.packbits(last, bitorder="little"))
        points.append(np.packbits((part & 0xC0) != 0x80, bitorder="little"))
    join = lambda parts: Bits(np.concatenate(parts) if parts else np.zeros(0, np.uint8))
    return join(units), join(points)


def draws(seed: int, doc_id: object) -> list[int]:
    """Four 32-bit numbers from the SHA-256 of seed and id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def cuts(texts: Sequence[bytes], drawn: Sequence[Sequence[int]]) -> list[tuple[int, int, int, int, int]]:
    """Of each text: number of units, byte where the prefix ends, byte where the middle ends, code points of both."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    units, points = bitvectors(data, ends[np.diff(ends, prepend=0) > 0])
    first = units.rank(starts)
    n = units.rank(ends) - first
    h = np.array(drawn, np.int64).reshape(-1, 4)
    sides = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    places = []
    for side in (sides[:, 0], sides[:, 1]):
        at = starts.copy()
        some = side > 0
        at[some] = units.select((first + side - 1)[some]) + 1
        places.append(at)
    ranks = [points.rank(at) for at in (starts, *places)]
    return list(zip(n.tolist(), (places[0] - starts).tolist(), (places[1] - starts).tolist(), (ranks[1] - ranks[0]).tolist(), (ranks[2] - ranks[1]).tolist(), strict=True))


def restore(output: bytes, form: str, sentinels: Sequence[str] = SENTINELS) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    opening, second = (s, p) if form == "spm" else (p, s)
    if not output.startswith(opening) or (at := output.find(second)) < 0 or (mid := output.find(m)) < 0:
        raise ValueError(f"an output of form {form} lacks its sentinels")
    one, two, middle = output[len(opening) : at], output[at + len(second) : mid], output[mid + len(m) :]
    return two + middle + one if form == "spm" else one + middle + two


def _sound(sentinels: Sequence[str]) -> None:
    """Raises if a sentinel could be found where a text meets another one, so that outputs would be ambiguous."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(x in y for x in sentinels for y in sentinels if x is not y):
        raise ValueError("three sentinels are due, none within another")
    if any(x.endswith(y[:i]) for x in sentinels for y in sentinels for i in range(1, len(y)) if i < len(x)):
        raise ValueError("a sentinel must not end as one begins")


def fill_in_middle(docs: DataFrame, seed: int = 42, middle_percent: int = MIDDLE_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row."""
    _sound(sentinels)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    p, s, m = sentinels

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                drawn = [draws(seed, x) for x in part.column(0).to_pylist()]
                raw = [t.encode() for t in texts]
                rows = []
                for text, whole, h, (n, a, b, prefix, middle) in zip(texts, raw, drawn, cuts(raw, drawn), strict=True):
                    if not text or h[2] % 100 >= middle_percent or any(x in text for x in sentinels):
                        rows.append((n, "plain", None, None, text))
                        continue
                    one, two, three = whole[:a].decode(), whole[a:b].decode(), whole[b:].decode()
                    spm = h[3] % 100 < suffix_first_percent
                    rows.append((n, "spm" if spm else "psm", prefix, middle, f"{s}{three}{p}{one}{m}{two}" if spm else f"{p}{one}{s}{three}{m}{two}"))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    source = id_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) to the digests of the outputs and of the texts rebuilt from them."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("form")
            for part, outputs in slices(batch, "output"):
                raw = [x.encode() for x in outputs]
                texts = (restore(x, form, sentinels) for x, form in zip(raw, part.column(at).to_pylist(), strict=True))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (raw, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *digests], [*part.schema.names[:5], "output_sha256", "restored_sha256"])

    source = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:5])
    return source.mapInArrow(run, f"{kept}, output_sha256 string, restored_sha256 string")


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and rebuilt."""
    return restored(fill_in_middle(documents(spark, sf_dir)))


OP12_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS d FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM t),
    h AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(units) + 1) AS y,
          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 50 THEN 'plain'
               WHEN ('0x' || d[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, array_to_string(units[1:least(x, y)], '') AS one, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS two, array_to_string(units[greatest(x, y) + 1:], '') AS three FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(one) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(two) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || one || '<S>' || three || '<M>' || two ELSE '<S>' || three || '<P>' || one || '<M>' || two END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""
