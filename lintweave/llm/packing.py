"""Operator 7: best-fit packing with exact complements.

Texts become token ids (the vocabulary, merges and added tokens of a ``tokenizers`` BPE file, run by tiktoken, which gives
the same ids several times faster) and an end id. A text of more than CAPACITY ids is cut into pieces of CAPACITY, of which the
first may be shorter. Packing needs the number of pieces of each length only, at most CAPACITY numbers, so the driver
plans on this histogram whatever the size of the corpus: for each length, longest first, the histogram is searched
for singles, pairs and triples that fill the gap exactly, used as often as counts allow; what remains goes
best-fit. Each piece then finds its place by its rank within its length; only pieces' numbers are shuffled, never texts.

Null and empty texts are one piece holding the end id. Repeated rows are packed one by one. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_text
from .common import Shelf, documents, id_text, slices

CAPACITY = 1024
END_ID = 2


@lru_cache(maxsize=2)
def bpe_of_json(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE file of ``tokenizers`` whose ids follow its merges.

    Its added tokens are split off first, wherever they stand, as that library does without any option.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"]):
        raise ValueError("added tokens that take blanks or whole words aren't supported")
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth piece of its length that partition part made."""

    def run(batches):
        enc, seen, part_id = bpe_of_json(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in slices(batch):
                take, cols = [], [[] for _ in range(6)]
                for row, text in enumerate(texts):
                    ids = np.append(encode_text(enc, text, special=True), np.uint32(END_ID)).astype("<u4")
                    start, k = 0, 0
                    while start < len(ids):
                        size = capacity if k or len(ids) <= capacity else len(ids) % capacity or capacity
                        piece = ids[start : start + size]
                        take.append(row)
                        for col, v in zip(cols, (k, start, len(piece), zlib.crc32(piece.tobytes()), part_id, seen[len(piece)]), strict=True):
                            col.append(v)
                        seen[len(piece)] += 1
                        start, k = start + size, k + 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, number of such sequences)] that uses up the counts of each length.

    Longest first: a length takes the singles, pairs and triples that fill its gap exactly, searched in the histogram, as
    often as counts allow; what is left of it takes the combination with the largest sum that fits, again and again.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []

    def use(combo: list[int]) -> None:
        need = defaultdict(int)
        for x in combo:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            out.append((combo, times))
            for x, k in need.items():
                left[x] -= k * times

    def exact_pairs(total: int, top: int) -> np.ndarray:
        """The larger parts a <= top of pairs that are there with this sum, largest first."""
        a = np.arange(min(total - 1, top), (total + 1) // 2 - 1, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)] if len(a) else a

    def nearest(gap: int) -> list[int]:
        """The single, pair or triple with the largest sum up to gap, of what is there; the fewest parts if sums tie."""
        there = np.flatnonzero(left[: gap + 1])
        if not len(there):
            return []
        best = [int(there[-1])]

        def pair(room: int, held: int) -> list[int]:
            """As nearest, of two parts, one of held being taken."""
            own = left.copy() if held else left
            if held:
                own[held] -= 1
            x = there[own[there] > 0]
            x = x[x < room]
            if not len(x):
                return []
            k = np.searchsorted(x, room - x, side="right") - 1
            y = np.where(k >= 0, x[np.maximum(k, 0)], 0)
            twin = (y == x) & (own[x] < 2)
            y = np.where(twin, np.where(k > 0, x[np.maximum(k - 1, 0)], 0), y)
            i = int(np.where(y > 0, x + y, 0).argmax())
            return [int(x[i]), int(y[i])] if y[i] > 0 else []

        found = pair(gap, 0)
        if sum(found) > sum(best):
            best = found
        if sum(best) < gap:
            for c in there[::-1]:
                if 3 * c <= sum(best):
                    break
                found = pair(gap - int(c), int(c))
                if found and int(c) + sum(found) > sum(best):
                    best = [int(c), *found]
                    if sum(best) == gap:
                        break
        return best

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if not left[length]:
            continue
        if not gap:
            use([length])
            continue
        if gap <= length and left[gap]:
            use([length, gap])
        for a in exact_pairs(gap, length):
            if not left[length]:
                break
            use([length, int(a), int(gap - a)])
        for a in range(min(gap - 2, length), (gap + 2) // 3 - 1, -1):
            if not left[length]:
                break
            if left[a]:
                for b in exact_pairs(gap - a, a):
                    use([length, a, int(b), int(gap - a - b)])
                    if not left[length] or not left[a]:
                        break
        while left[length]:
            combo = [length]
            left[length] -= 1
            while more := nearest(capacity - sum(combo)):
                combo += more
                for x in more:
                    left[x] -= 1
            for x in combo:
                left[x] += 1
            use(combo)
    return out


def places(planned: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of equal places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for length in lengths:
            runs[length].append((rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, path: str, shelf: Shelf, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    made = shelf.put(pieces(docs, path, id_col, text_col, capacity), "pieces")
    sums = shelf.put(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "sums")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = made.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    first = sums.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS first")
    # its rows grow with the partitions: never broadcast, whatever Spark thinks of its size
    ranked = made.join(first.hint("merge"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                ranks, sequences, offsets = where.value[int(x)]
                at = np.flatnonzero(length == x)
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = sequences[i] + rank[at] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    given = ranked.select(*cols, "rank")
    kind = made.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), Shelf(spark, "op7"))
