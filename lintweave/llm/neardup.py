"""Operator 6: near-duplicates by MinHash and a multi-index Hamming join.

A document is its set of distinct shingles of WIDTH words. Documents with the same set form a class, which has an integer
of its own and goes on with the text of its smallest id. A class has a signature of CHUNKS * SPAN MinHash values of 16
bits. Two signatures that differ in at most 2 * CHUNKS - 1 values have, by the pigeonhole principle, a chunk in which at
most one value differs; so each chunk is indexed SPAN times, each time without one of its values, and every pair within
that distance shares a key. (A pair at similarity 0.8 lacks such a chunk with probability 1e-7.)

Links are looked for in three passes, each of which drops what the one before has settled: (1) each class is compared with
its anchor, of the smallest classes of its keys the one that shares most keys with it; (2) of each key whose classes still lie in different components,
the smallest and the largest class are compared with the classes of other components; (3) classes of one key that lie in
different components even then are compared where their differences from a common class allow a link (see ``unsettled``).
So a group of near copies costs about one comparison for each copy, and no link between components is lost. A comparison
looks at sizes and signatures first, then confirms on the full sets of 64-bit shingle hashes, made again from whole texts.

Texts without words have the empty set and no links; null texts are empty. Rows that repeat an id with another text are
compared on their own, and a component's id is the smallest of its rows; rows with a null id link nothing, but belong to the
component of documents with their set (null if there is none). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, documents, id_text, slices
from .components import components

CHUNKS, SPAN = 12, 5
VALUES = CHUNKS * SPAN
#: Signatures that differ in more values aren't compared in full: at similarity 0.8, a chance of 1e-9.
FARTHEST = 32
WIDTH, PERCENT = 5, 80
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(21).integers(1, 1 << 63, (2, VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words (split at ASCII white space, A-Z lower-cased): 64-bit hashes, first and end byte, and text."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << max(20, len(data).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    bounds = np.cumsum([len(x) + 1 for x in raw])
    return hashes, starts, ends, np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; with fewer words, all of them as one."""
    hashes, _, _, owner = word_hashes(texts)
    size = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i, n in enumerate(size):
        h = hashes[first[i] : first[i + 1]]
        n_shingles = max(1, n - width + 1) if n else 0
        k = min(n, width)
        s = np.zeros(n_shingles, np.uint64)
        for j in range(k):
            s = s * _BASE + h[j : j + n_shingles]
        out.append(np.unique(mixed(s + np.uint64(k))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, the last 16 bits but 20 of each."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    if sets:
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
        for j in range(VALUES):
            low = np.minimum.reduceat(flat * _FACTORS[0, j] + _FACTORS[1, j], starts)
            out[:, j] = (low >> np.uint64(20)).astype(np.uint16)
    return out


def set_name(shingles: np.ndarray) -> bytes | None:
    """16 bytes that name a set; None for the empty one."""
    return hashlib.sha256(shingles.tobytes()).digest()[:16] if len(shingles) else None


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_sha256, n_shingles, set_id, sig) of (doc_id, text); set_id and sig are null for the empty set. No shuffle."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, width)
                sigs = iter(signatures([x for x in sets if len(x)]))
                cols = [pa.array([len(x) for x in sets], pa.int64()), pa.array([set_name(x) for x in sets], pa.binary()), pa.array([next(sigs).tobytes() if len(x) else None for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], ["doc_id", "text_sha256", "n_shingles", "set_id", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")).mapInArrow(run, f"doc_id {kind}, text_sha256 string, n_shingles long, set_id binary, sig binary")


def keyed(classes: DataFrame) -> DataFrame:
    """Each class of (sig, ...) CHUNKS * SPAN times, a key in place of sig."""
    rest = [x for x in classes.columns if x != "sig"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                sig = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16).reshape(-1, CHUNKS, SPAN).astype(np.uint64)
                keys = np.empty((len(sig), CHUNKS, SPAN), np.uint64)
                tags = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(SPAN + 1)
                for out in range(SPAN):
                    k = np.broadcast_to(tags + np.uint64(out + 1), sig.shape[:2])
                    for j in range(SPAN):
                        if j != out:
                            k = mixed(k * _BASE + sig[:, :, j])
                    keys[:, :, out] = k
                flat = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * VALUES), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], [*rest, "keys"])

    kinds = "".join(f"{x} {classes.schema[x].dataType.simpleString()}, " for x in rest)
    return classes.select("sig", *rest).mapInArrow(run, f"{kinds}keys array<bigint>").select(*rest, F.explode("keys").alias("key"))


def close(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of (a, b) whose sizes and signatures allow the similarity, with the ids and sets of both, as ``compared`` needs them."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("set_id").alias(f"set_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b")
    near = near.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    names = ["a", "b", "doc_a", "set_a", "doc_b", "set_b"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, VALUES) for i in (0, 1))
                yield batch.select(names).filter(pa.array((x != y).sum(axis=1) <= FARTHEST))

    near = near.select("sig_a", "sig_b", *names)
    return near.mapInArrow(run, ", ".join(f"{x} {near.schema[x].dataType.simpleString()}" for x in names))


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, details: bool = False) -> DataFrame:
    """Those of (a, b) whose full sets reach the similarity: 100 * intersection >= percent * union.

    Pairs that ``close`` made have their ids and sets already. With details all pairs, as (a, b, n, n_b, apart): sizes, and the shingles of a that b lacks, then those of b that a lacks.
    """
    of = lambda x: classes.select(F.col("id").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("set_id").alias(f"set_{x}"))
    text = lambda x: docs.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}"))
    named = pairs if "doc_a" in pairs.columns else pairs.join(of("a"), "a").join(of("b"), "b")
    both = named.join(text("a"), "doc_a").join(text("b"), "doc_b").select("a", "b", "text_a", "text_b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            for part, left in slices(batch, "text_a"):
                right, sets, distinct = part.column(3).to_pylist(), shingle_sets(left, width), {}
                for y in right:
                    if y not in distinct:
                        distinct[y] = (own := shingle_sets([y], width)[0]), set_name(own)
                # an id that rows repeat brings texts of other classes too
                own = [set_name(x) == m and distinct[y][1] == n for x, y, m, n in zip(sets, right, part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                part = part.filter(pa.array(own, pa.bool_()))
                two = [(x, distinct[y][0]) for x, y, mine in zip(sets, right, own, strict=True) if mine]
                if details:
                    apart = [np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)]) for x, y in two]
                    lists = pa.array([x.view(np.int64) for x in apart], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([len(z[i]) for z in two], pa.int64()) for i in (0, 1)), lists], ["a", "b", "n", "n_b", "apart"])
                    continue
                keep = []
                for x, y in two:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long" + ", n long, n_b long, apart array<bigint>" * details)


def relabelled(labels: DataFrame, links: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """labels (id, component, ...) with the components that links (a, b) join as one, named by their smallest."""
    part = lambda x, to: labels.select(F.col("id").alias(x), F.col("component").alias(to))
    edges = links.join(part("a", "x"), "a").join(part("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = components(edges, shelf, name).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return labels.join(whole, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole").select(*labels.columns)


def opposed(left: DataFrame, right: DataFrame, shelf: Shelf, name: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of left and right (b, shingle, a, x, n, cost, slack) that other components of their (b, shingle) may meet.

    Both have the two components that meet, (x, z): rows of equal (b, shingle, x, z) are to be paired, and x <> z. A row
    stands for its component in (b, shingle) by bounds, one row for each, so that no two rows of one component come together.
    A pair needs the slack of each to reach the cost of the other; a row stays if the bounds of the other component allow it.
    """
    place = ["b", "shingle"]
    bounds = lambda rows: rows.groupBy(*place, "x").agg(F.max("slack").alias("slack"), F.min("cost").alias("cost"), F.min("n").alias("least"), F.max("n").alias("most"))
    theirs = bounds(right).withColumnsRenamed({"x": "z", "slack": "slack_z", "cost": "cost_z", "least": "least_z", "most": "most_z"})
    allowed = (F.col("slack") >= F.col("cost_z")) & (F.col("slack_z") >= F.col("cost"))
    sized = (F.col("most") * 100 >= F.col("least_z") * percent) & (F.col("most_z") * 100 >= F.col("least") * percent)
    pairs = bounds(left).join(theirs, place).filter((F.col("x") != F.col("z")) & allowed & sized)
    pairs = shelf.put(pairs.select(*place, "x", "z", "slack", "cost", "slack_z", "cost_z"), f"{name}-pairs")
    ours = left.join(pairs.drop("slack", "cost"), [*place, "x"]).filter(allowed).drop("slack_z", "cost_z")
    theirs = right.withColumnsRenamed({"x": "z", "a": "o", "n": "m", "cost": "cost_z", "slack": "slack_z"})
    theirs = theirs.join(pairs.drop("slack_z", "cost_z"), [*place, "z"]).filter(allowed).drop("slack", "cost")
    return ours, theirs


def met(left: DataFrame, right: DataFrame, shelf: Shelf, name: str, percent: int = PERCENT) -> DataFrame:
    """(a, b), the larger first: rows of left and right that meet in a shingle, lie in different components and may link."""
    ours, theirs = opposed(left, right, shelf, name, percent)
    enough = (F.col("slack") >= F.col("cost_z")) & (F.col("slack_z") >= F.col("cost"))
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    found = ours.join(theirs, ["b", "shingle", "x", "z"]).filter((F.col("a") != F.col("o")) & enough & sized)
    return found.select(F.greatest("a", "o").alias("a"), F.least("a", "o").alias("b"))


def unsettled(labels: DataFrame, classes: DataFrame, source: DataFrame, shelf: Shelf, width: int, percent: int) -> DataFrame:
    """(a, b): pairs that share a key, lie in different components and may reach the similarity.

    A key's hub is the anchor of all its classes if they have the same one, else its smallest class; all its classes have
    been compared with it. With h the hub and D(x) the symmetric difference of x and h, that of x and y holds
    |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, so that a link needs
    |D(x) & D(y)| >= (|D(x)| + |D(y)| - r (|x| + |y|)) / 2 with r = (100 - percent) / (100 + percent).
    One of the two isn't in the component of h (a stray): its D has more than r (|x| + |h|) shingles. From this follow
    least values of the right side that depend on one class only, and prefixes of each D that must share a shingle, the
    shingles being ordered by their number of classes at h, the rarest first. Pairs are found by joining the prefixes;
    the place of a shingle in both also tells how many can follow: with at the place of the shingle in D(x), 2 (100 + percent)
    (|D(x)| - at) must reach cost(x) + cost(y), where cost(x) = (100 + percent) |D(x)| - (100 - percent) |x|. Components meet
    before their classes do (see ``opposed``), so that classes of one component aren't paired.
    """
    keys = keyed(labels.select("id", "sig", "component", "anchor"))
    low, high = F.min("anchor"), F.max("anchor")
    open_keys = keys.groupBy("key").agg(F.when(low == high, low).otherwise(F.min("id")).alias("hub"), F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("n"))
    # of three classes or fewer all pairs have been compared
    open_keys = shelf.put(open_keys.filter("c <> d AND n > 3").select("key", "hub"), "open-keys")
    at = keys.join(open_keys, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("component").alias("x")).distinct()
    stars = shelf.put(at.join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b").select("a", "b", "x", "y"), "members")
    sizes = stars.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    open_hubs = shelf.put(sizes.groupBy("b").agg(F.max_by("x", F.struct("n", "x")).alias("major"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("b", "major"), "open-hubs")
    held = compared(stars.join(open_hubs, "b", "left_semi").select("a", "b"), classes, source, width, percent, details=True)
    held = held.join(stars, ["a", "b"]).join(open_hubs, "b").withColumn("d", F.size("apart").cast("long"))
    two, r = F.lit(2 * (100 + percent)), 100 - percent
    least = lambda c: F.greatest(F.lit(1), F.ceil(((100 + percent) * F.col("d") + r * c) / two))
    held = held.select("a", "b", "x", "n", "d", "apart", (F.col("x") != F.col("y")).alias("stray"), (F.col("x") != F.col("major")).alias("minor"),
                       (F.col("d") - least(-F.col("n") - F.col("n_b")) + 1).cast("int").alias("as_stray"), (F.col("d") - least(F.col("n_b") - F.col("n")) + 1).cast("int").alias("as_other"))
    held = shelf.put(held, "details")
    each = held.select("a", "b", F.explode("apart").alias("shingle"))
    often = each.groupBy("b", "shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # places in the order of a and b, whose first shingles are those that no other class has at the hub
    own = Window.partitionBy("a", "b")
    ranked = each.join(often, ["b", "shingle"]).select("a", "b", "shingle", F.row_number().over(own.orderBy("c", "shingle")).alias("nth"), F.count(F.lit(1)).over(own).alias("m"))
    ranked = ranked.join(held.drop("apart"), ["a", "b"]).withColumn("at", (F.col("d") - F.col("m") + F.col("nth") - 1).cast("int")).drop("m", "nth")
    ranked = shelf.put(ranked.filter("at < greatest(as_stray, as_other)"), "ranked")
    cost = (100 + percent) * F.col("d") - r * F.col("n")
    slack = two * (F.col("d") - F.col("at")) - cost

    # two kinds of prefix, as the stray of a pair and as the other one
    def prefixes(which: str, upto: str) -> DataFrame:
        return ranked.filter(which).filter(F.col("at") < F.col(upto)).select("b", "shingle", "a", "x", "n", cost.alias("cost"), slack.alias("slack"))

    strays = met(prefixes("minor AND stray", "as_stray"), prefixes("true", "as_other"), shelf, "strays", percent)
    others = met(prefixes("minor AND NOT stray", "as_other"), prefixes("stray", "as_stray"), shelf, "others", percent)
    return strays.unionByName(others).distinct()


def near_groups(docs: DataFrame, shelf: Shelf, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_sha256, n_shingles, component_id, kept), a row for each row of docs; the smallest id of a component is kept."""
    source = id_text(docs, id_col, text_col)
    sketches = shelf.put(sketch(source, width), "sketches")
    classes = sketches.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("c"))
    # integers in the order of ids, so that originals come before their copies; written once, they are the same for all readers
    classes = classes.select("set_id", "c.*").repartitionByRange("doc_id", "set_id").sortWithinPartitions("doc_id", "set_id")
    classes = shelf.put(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        return shelf.put(compared(shelf.put(close(pairs, classes, percent), f"{name}-near"), classes, source, width, percent), f"{name}-links")

    keys = keyed(classes.select("id", "sig"))
    lows = shelf.put(keys.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "low"), "lows")
    shared = keys.join(lows, "key").groupBy("id", "low").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(F.when(F.col("low") != F.col("id"), F.col("n")).otherwise(F.lit(0)), -F.col("low"))
    anchors = shelf.put(shared.groupBy("id").agg(F.max_by("low", best).alias("anchor")), "anchors")
    alone = classes.select("id", "sig", F.col("id").alias("component")).join(anchors, "id", "left").withColumn("anchor", F.coalesce("anchor", "id"))
    first = linked(anchors.filter("id <> anchor").select(F.col("id").alias("a"), F.col("anchor").alias("b")), "first")
    # classes that share no key with others are settled
    labels = shelf.put(relabelled(alone.join(anchors, "id", "left_semi"), first, shelf, "one"), "labels1")

    keys = keyed(labels.select("id", "sig", "component", "anchor"))
    end = F.struct("id", "component")
    ends = keys.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.min("component").alias("c"), F.max("component").alias("d"))
    ends = shelf.put(ends.filter("c <> d").select("key", "low", "high"), "ends")
    stars = keys.join(ends, "key").select("id", "component", "anchor", F.explode(F.array("low", "high")).alias("end"))
    stars = stars.filter("component <> end.component AND anchor <> end.id").select(F.greatest("id", "end.id").alias("a"), F.least("id", "end.id").alias("b")).distinct()
    second = linked(shelf.put(stars, "stars"), "second")
    labels = shelf.put(relabelled(labels, second, shelf, "two"), "labels2")

    third = linked(shelf.put(unsettled(labels, classes, source, shelf, width, percent), "rest"), "third")
    labels = shelf.put(relabelled(labels, third, shelf, "three"), "labels3")

    rows = classes.select("id", "set_id").join(labels.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # a component is the smallest of its classes, which has its smallest doc_id
    names = classes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
    by_set = shelf.put(rows.join(names, "component").select("set_id", "component_id"), "by-set")
    shelf.keep("sketches", "by-set")
    out = sketches.join(by_set, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_sha256", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by shingles of two words."""
    return near_groups(documents(spark, sf_dir), Shelf(spark, "op6"), width=2).drop("text_sha256")
