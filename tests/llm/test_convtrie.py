"""The trie against one made of all prefixes by hand; over one range and many."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lintweave.llm import convtrie
from lintweave.llm.common import Shelf

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n long, path string, kind string"


def symbol(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, symbol(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple([*own.get(base, [])[:h], *turns[h:]])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = Counter(x[:-1] for x in members if x), Counter(), Counter()
    for x, who in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in kids
            saved[x[:d]] += (len(who) - 1) * len(x[-1][1]) if x else 0
    ids = lambda x: hashlib.sha256(",".join(map(str, sorted(ends.get(x, [])))).encode()).hexdigest()
    return sorted((min(who), len(x), min(members[x[:-1]]) if x else -1, len(who), kids[x], leaves[x], saved[x], ids(x)) for x, who in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "k", 2, "p", "q") for x in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((x[0], x[1], -1 if x[2] is None else x[2], *x[3:]) for x in map(tuple, df.collect()))


def cases():
    rng = random.Random(11)
    text = lambda: rng.choice(("", "é", "a b", "hello", "hello there", "x" * 50, "\n"))
    rows = []
    for c in range(-3, 420):
        if c % 100 == 0 and c > 250:
            continue  # a hundred without its first
        kind = rng.random()
        if kind < 0.3:  # copies
            rows += [(c, t, "user", f"turn {t}") for t in range(7)]
        elif kind < 0.4:  # ends within the copies
            rows += [(c, t, "user", f"turn {t}") for t in range(rng.randrange(1, 7))]
        else:
            rows += [(c, t, rng.choice(("user", "assistant", None)), text()) for t in range(rng.randrange(1, 9))]
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(501, t, "user", f"long {t}") for t in range(290)] + [(503, t, "user", f"long {t}") for t in range(300)]
    rows += [(510, None, "a", "b"), (510, 0, "a", "b"), (510, 0, "a", "b"), (510, 1, None, None), (511, 3, "z", "tie"), (511, 3, "a", "tie"), (None, 0, "user", "nobody's"), rows[40], rows[40], (10**12, 0, "user", "far"), (600, 0, "u", "x" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_rows(spark, ranges):
    rows = cases()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = convtrie.trie(frame(spark, rows), Shelf(spark, "test"))
        assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert {t for _, t in out.dtypes} == {"bigint", "string"}
        got, want = found(out), by_hand(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == want


def test_lists():
    """Lists that ranges cut meet again, whatever the pieces."""
    rng = random.Random(1)
    rows = sorted((bytes([rng.choice((0, 0, 0, 1, 2, 3))]), c) for c in rng.sample(range(10_000), 200))
    for cuts in ([], [1], [40, 90, 91, 150], list(range(1, 200))):
        parts = [x for a, b in zip([0, *cuts], [*cuts, 200], strict=True) for x in convtrie._listed(iter(rows[a:b]), 7)]
        pieces = sorted((k, c, n, ids) for k, n, c, digest, ids in parts if digest is None)
        got = sorted([x[:4] for x in parts if x[3]] + list(convtrie._joined(iter(pieces))))
        ids = {k: [c for x, c in rows if x == k] for k, _ in rows}
        assert got == [(k, len(v), v[0], hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in sorted(ids.items())]


def strings(rng, n):
    made = {tuple(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(n)}
    size = {x: rng.randrange(5) for x in [(), *{y[:d] for y in made for d in range(1, len(y) + 1)}]}
    code = {"a": b"a" * 16, "b": b"b" * 16}
    return [(b"".join(code[s] for s in x), [size[x[:d]] for d in range(1, len(x) + 1)], rng.randrange(1, 4), 100 + i) for i, x in enumerate(sorted(made))]


def test_points():
    """Of one range: no point but branches, ends, leaves and those of its outer paths; sums are right."""
    rng = random.Random(3)
    for n in (1, 2, 5, 30):
        own = strings(rng, n)
        rows = [x for x in convtrie.points(iter(own), 7) if x[0] in (convtrie.INNER, convtrie.OUTER)]
        prefixes = {p[:i] for p, *_ in own for i in range(0, len(p) + 1, 16)}
        below = lambda x, own=own: [y for y in own if y[0].startswith(x)]
        kids = Counter(x[:-16] for x in prefixes if x)
        outer = {p[:i] for p in (own[0][0], own[-1][0]) for i in range(0, len(p) + 1, 16)}
        due = {x for x in prefixes if x in outer or kids[x] != 1 or x in {p for p, *_ in own}}
        assert {x[3] for x in rows} == {convtrie.name(x) for x in due} and len(rows) == len(due)
        by_name = {convtrie.name(x): x for x in prefixes}
        for _, part, depth, key, _, _, conv_id, members, a, b, leaves, _, suffix in rows:
            x = by_name[key]
            inside = below(x)
            assert (part, depth, conv_id, members) == (7, len(x) // 16, min(y[3] for y in inside), sum(y[2] for y in inside))
            assert a == sum(y[2] * sum(y[1][max(depth - 1, 0) :]) for y in inside)
            size = {y[0][: 16 * d]: y[1][d - 1] for y in own for d in range(1, len(y[1]) + 1)}
            assert b == sum(size[z] for z in size if z.startswith(x)) and leaves == sum(not kids[z] for z in prefixes if z.startswith(x)) and suffix[-1] == 0


def test_small(spark):
    assert convtrie.trie(frame(spark, []), Shelf(spark, "test")).count() == 0
    # all that 1 has is taken from 0, which isn't there: it is turnless where its first turns go
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone")]
    assert found(convtrie.trie(frame(spark, rows), Shelf(spark, "test"))) == by_hand(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query(spark, tmp_path):
    import __spark_entry__ as entry

    rows = cases()[:500]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(entry.queries()["op13_trie"](spark, str(tmp_path))) == by_hand(rows)
