"""Operator 13: the prefix trie of conversations, built as a Patricia trie.

A turn becomes a symbol, the first 16 bytes of the SHA-256 of its role and text; a conversation becomes the string of its
symbols, one row. Copies are counted first, in ranges of (string, conv_id), so that a string that very many conversations
have is spread. The distinct strings are sorted, by ranges of their first SORTED turns and then in full within a range. One
pass over a range keeps the open path on a stack: neighbours' common prefixes tell where to close points, so that only
branch points, ends and leaves are created, with the edges between them compressed. Aggregates are summed on these points
as they close. The strings that open and close a range get a point at each depth: whatever node lies in several ranges is
one of them, so the ranges' partial sums meet by key, a few rows for each range, and the common prefix of neighbouring
ranges tells what both have counted. Edges are expanded at last: a unary node's sums are those of its edge's lower end and
the edge's suffix sums.

saved tokens are a difference of two sums that add up over ranges: characters from a node on, over all its members, less
those over distinct nodes.

Turns are ordered by turn (null first), those that tie by their symbols; null roles and texts are empty; rows without a
conv_id belong to no conversation. Repeated rows are turns of their own. Negative ids have their base nearer to zero. A
conversation of which nothing is left is a member of the root alone. An empty table gives no rows, not even a root; other
columns are ignored. One row holds a conversation's symbols and lengths (24 bytes a turn), never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf

SYMBOL = 16
#: Turns by which strings are dealt into ranges: the sample of ranges that Spark takes holds so many symbols a row.
SORTED = 16
#: Turns that a conversation may take from the first of its hundred, less 1.
HEADS = 6
#: Conversation ids in one piece of a list that goes beyond a range; rows of an Arrow batch that leaves Python.
PIECE = 1 << 14
ROWS = 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()
_POINT = {"kind": pa.int32(), "part": pa.int32(), "depth": pa.int64(), "key": pa.binary(), "up_depth": pa.int64(), "up_key": pa.binary(), "conv_id": pa.int64(), "n": pa.int64(), "a": pa.int64(), "b": pa.int64(), "leaves": pa.int64(), "kids": pa.int64(), "suffix": pa.list_(pa.int64())}
#: Kinds of rows that a range gives: a point within it, a point on one of its outer paths, its first string's prefixes, its last one's.
INNER, OUTER, FIRST, LAST = range(4)


def name(path: bytes) -> bytes:
    """A node's key."""
    return hashlib.sha256(path).digest()[:SYMBOL]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars): each conversation's symbols and lengths, its first turns from the first of its hundred."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    symbol = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SYMBOL)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("some"), "turn", symbol.alias("symbol"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.symbol").alias("symbols"), F.col("t.chars").alias("chars"))
    first = F.slice("symbols", 1, HEADS - 1), F.slice("chars", 1, HEADS - 1)
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), first[0].alias("head_symbols"), first[1].alias("head_chars"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    rows = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left")

    def spliced(head: str, tail: str, kind: str):
        rest = F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail) - F.col("h"), F.lit(0)))
        return F.concat(F.slice(F.coalesce(F.col(head), F.array().cast(kind)), F.lit(1), F.col("h")), rest)

    path = F.unhex(F.array_join(spliced("head_symbols", "symbols", "array<string>"), ""))
    return rows.select("conv_id", path.alias("path"), spliced("head_chars", "chars", "array<bigint>").alias("chars"))


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield make()
            held = []
    if held:
        yield make()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns), strict=True)


def _listed(rows: Iterator[tuple[bytes, int]], piece: int = PIECE) -> Iterator[tuple]:
    """(key, n, conv_id, digest, ids) of sorted (key, conv_id): ids in pieces of the range's first and last key, else a digest."""

    def done(key: bytes, ids: list[int], outer: bool) -> Iterator[tuple]:
        if not outer:
            yield key, len(ids), ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), None
            return
        for i in range(0, len(ids), piece):
            yield key, len(own := ids[i : i + piece]), own[0], None, ",".join(map(str, own))

    before, first = None, True
    for key, run in groupby(rows, itemgetter(0)):
        if before:
            yield from done(*before, first)
            first = False
        before = key, [c for _, c in run]
    if before:
        yield from done(*before, True)


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, n, conv_id, digest) of pieces (key, conv_id, n, ids) in order."""
    for key, run in groupby(rows, itemgetter(0)):
        hashed, n, least = hashlib.sha256(), 0, None
        for _, c, m, ids in run:
            hashed.update(("," if n else "").encode() + ids.encode())
            least, n = c if least is None else least, n + m
        yield key, n, least, hashed.hexdigest()


def copies(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, n, conv_id, digest) of rows (conv_id, path): each distinct path's number, smallest id and SHA-256 of its ids."""
    key = F.substring(F.unhex(F.sha2("path", 256)), 1, SYMBOL)
    kinds = {"key": pa.binary(), "n": pa.int64(), "conv_id": pa.int64(), "digest": pa.string(), "ids": pa.string()}
    dealt = rows.select(key.alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = shelf.put(dealt.mapInArrow(lambda b: _batches(_listed(_unpacked(b)), kinds), "key binary, n long, conv_id long, digest string, ids string"), "listed")
    pieces = made.filter("digest IS NULL").select("key", "conv_id", "n", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    joined = pieces.mapInArrow(lambda b: _batches(_joined(_unpacked(b)), {x: kinds[x] for x in list(kinds)[:4]}), "key binary, n long, conv_id long, digest string")
    return made.filter("digest IS NOT NULL").drop("ids").unionByName(joined)


def common(a: bytes, b: bytes) -> int:
    """Symbols that both strings begin with."""
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        mid = (low + high + 1) // 2
        at = low * SYMBOL
        if a[at : mid * SYMBOL] == b[at : mid * SYMBOL]:
            low = mid
        else:
            high = mid - 1
    return low


class _Open:
    """A point on the open path; sums are over what has closed below it."""

    __slots__ = ("a", "b", "conv_id", "depth", "kids", "leaf", "leaves", "key", "n", "outer")

    def __init__(self, depth: int, key: bytes, outer: bool = False, n: int = 0, conv_id: int | None = None):
        self.depth, self.key, self.outer, self.n, self.conv_id = depth, key, outer, n, conv_id
        self.a = self.b = self.leaves = self.kids = 0
        self.leaf = True


def _names(path: bytes) -> list[bytes]:
    """Of all prefixes."""
    hashed, out = hashlib.sha256(), [name(b"")]
    for i in range(0, len(path), SYMBOL):
        hashed.update(path[i : i + SYMBOL])
        out.append(hashed.copy().digest()[:SYMBOL])
    return out


def points(strings: Iterator[tuple[bytes, list[int], int, int]], part: int) -> Iterator[tuple]:
    """Rows of _POINT for a range's distinct strings (path, chars, n, conv_id) in order."""
    path, sums, stack = b"", [0], []

    def close(up: _Open, node: _Open) -> tuple:
        size = sums[node.depth] - sums[node.depth - 1]
        node.a += node.n * size
        node.b += size
        node.leaves += node.leaf
        edge = sums[node.depth - 1] - sums[up.depth]
        up.n += node.n
        up.conv_id = node.conv_id if up.conv_id is None else min(up.conv_id, node.conv_id)
        up.a += node.a + node.n * edge
        up.b += node.b + edge
        up.leaves += node.leaves
        up.kids += not node.outer
        up.leaf = False
        suffix = [sums[node.depth - 1] - sums[k - 1] for k in range(up.depth + 1, node.depth + 1)]
        return OUTER if node.outer else INNER, part, node.depth, node.key, up.depth, up.key, node.conv_id, node.n, node.a, node.b, node.leaves, node.kids, suffix

    for new, chars, n, conv_id in strings:
        if not stack:
            stack = [_Open(d, k, True) for d, k in enumerate(_names(new))]
            stack[-1].n, stack[-1].conv_id = n, conv_id
            new_sums = [0, *accumulate(chars)]
            for x in stack:
                yield (FIRST, part, x.depth, x.key, None, None, None, None, new_sums[x.depth], new_sums[max(x.depth - 1, 0)], None, None, None)
        else:
            shared = common(path, new)
            while stack[-1].depth > shared:
                node = stack.pop()
                if stack[-1].depth < shared:
                    stack.append(_Open(shared, name(path[: shared * SYMBOL])))
                yield close(stack[-1], node)
            stack.append(_Open(len(new) // SYMBOL, name(new), False, n, conv_id))
            new_sums = [0, *accumulate(chars)]
        path, sums = new, new_sums
    if not stack:
        return
    have = {x.depth: x for x in stack}
    stack = [have.get(d) or _Open(d, k) for d, k in enumerate(_names(path))]
    for x in stack:
        x.outer = True
        yield (LAST, part, x.depth, x.key, None, None, None, int(x.depth == len(path) // SYMBOL), None, None, None, None, None)
    while len(stack) > 1:
        node = stack.pop()
        yield close(stack[-1], node)
    root = stack[0]
    yield (OUTER, part, 0, root.key, -1, None, root.conv_id, root.n, root.a, root.b, root.leaves + root.leaf, root.kids, [0])


def compressed(strings: DataFrame, shelf: Shelf) -> DataFrame:
    """(depth, key, up_depth, up_key, conv_id, n, a, b, leaves, kids, suffix): all points of distinct strings (path, chars, n, conv_id).

    n: members; a: characters from the point on over all members, b: over distinct nodes; suffix: for each node of the edge
    above, from the top, the characters between it and the point.
    """
    dealt = strings.select("path", "chars", "n", "conv_id").repartitionByRange(F.substring("path", 1, SORTED * SYMBOL)).sortWithinPartitions("path")
    spelled = ", ".join(f"{k} {'array<bigint>' if k == 'suffix' else {pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'}[t]}" for k, t in _POINT.items())
    made = shelf.put(dealt.mapInArrow(lambda b: _batches(points(_unpacked(b), TaskContext.get().partitionId()), _POINT), spelled), "points")
    inner = made.filter(F.col("kind") == INNER)
    outer = made.filter(F.col("kind") == OUTER)
    # what two neighbouring ranges have counted both: one row for each node that they share, of few for each range
    first = made.filter(F.col("kind") == FIRST).select("part", "depth", "key", F.col("a").alias("upto"), F.col("b").alias("above"))
    last = made.filter(F.col("kind") == LAST).select(F.col("part").alias("before"), "depth", "key", F.col("n").alias("whole"))
    follows = first.filter("depth = 0").select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    both = first.join(follows, "part").join(last, ["before", "depth", "key"])
    twice = both.groupBy("part").agg(F.max("upto").alias("end"), F.max("whole").alias("whole"))
    less = both.drop("whole").join(twice, "part").select("depth", "key", (F.col("above") - F.col("end")).alias("b"), (-F.col("whole")).alias("leaves"))
    sums = ("n", "a", "b", "leaves", "kids")
    parts = outer.select("depth", "key", "up_key", "conv_id", *sums).unionByName(less, allowMissingColumns=True)
    merged = parts.groupBy("depth", "key").agg(F.max("up_key").alias("up_key"), F.min("conv_id").alias("conv_id"), *(F.sum(x).alias(x) for x in sums))
    merged = shelf.put(merged, "outer")
    more = merged.groupBy(F.col("up_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    whole = merged.join(more, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    whole = whole.select("depth", "key", (F.col("depth") - 1).alias("up_depth"), "up_key", "conv_id", *sums, F.array(F.lit(0).cast("long")).alias("suffix"))
    return inner.select(*whole.columns).unionByName(whole)


def trie(conversations: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    rows = shelf.put(rebuilt(conversations), "rebuilt")
    known = shelf.put(copies(rows, shelf), "copies")
    strings = rows.join(known.select("conv_id", "n"), "conv_id")
    found = shelf.put(compressed(strings, shelf), "compressed")
    shelf.keep("copies", "compressed")
    ends = known.select("key", "digest")
    above = found.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_conv_id"))
    full = found.join(ends, "key", "left").join(above, "up_key", "left").select("*", F.posexplode("suffix").alias("place", "below"))
    depth = F.col("up_depth") + 1 + F.col("place")
    end = depth == F.col("depth")
    return full.select(
        "conv_id",
        depth.alias("depth"),
        F.when(F.col("place") == 0, F.col("up_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("a") - F.col("b") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.coalesce(F.when(end, F.col("digest")), F.lit(EMPTY)).alias("ends_sha256"),
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Shelf(spark, "op13"))


OP13_SQL = """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
               FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                 lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda u, i: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))) % 6 AS h
          FROM t GROUP BY conv_id),
    m AS (SELECT s.conv_id, s.h, least(s.h, coalesce(b.n, 0)) AS m FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 100),
    w AS (SELECT m.conv_id AS c, p AS d, r, x FROM m JOIN t ON t.conv_id = m.conv_id - m.conv_id % 100 AND p <= h
          UNION ALL SELECT m.conv_id, m + p - h, r, x FROM m JOIN t USING (conv_id) WHERE p > h),
    k AS (SELECT c, d, length(x) AS chars, sha256(string_agg(strlen(r) || ':' || strlen(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM w
          UNION ALL SELECT conv_id, 0, 0, '' FROM s),
    e AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM k),
    v AS (SELECT k, min(c) AS c, any_value(d) AS d, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM e GROUP BY k),
    j AS (SELECT v.*, coalesce(q.kids, 0) AS kids FROM v LEFT JOIN (SELECT up, count(*) AS kids FROM v WHERE up IS NOT NULL GROUP BY up) q ON q.up = v.k),
    g AS (SELECT e.k, sum((j.n - 1) * j.chars)::BIGINT AS saved, count(*) FILTER (WHERE j.kids = 0) AS leaves FROM j JOIN e ON e.c = j.c AND e.d <= j.d GROUP BY e.k)
    SELECT j.c AS conv_id, j.d AS depth, o.c AS parent_conv_id, j.n AS n_convs, j.kids AS n_children, g.leaves AS n_leaves, g.saved AS saved_tokens, sha256(coalesce(j.ends, '')) AS ends_sha256
    FROM j JOIN g USING (k) LEFT JOIN j o ON o.k = j.up"""
