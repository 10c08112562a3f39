"""Shared lines against a count by hand, over batches and levels."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintweave.llm import linededup
from lintweave.llm.common import Shelf

SCHEMA = "doc_id long, text string, n long, keeper string, batch int, gone boolean"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def by_hand(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    least = lambda i: -(10**18) if i is None else i
    keeper = {k: max(v, key=least) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cases():
    rng = random.Random(5)
    pool = [f"Shared line number {k} of the pool, {'é' * (k % 7)}" for k in range(40)] + ["x" * 19, "x" * 20, "é" * 19, "É" * 20, "é" * 20, "\x85" * 20, "short"]
    rows = []
    for i in range(300):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + [f"own line of document {i} only"] * rng.randrange(3)
        lines = [rng.choice(("", " ", "\t\x0b", "\x1c")) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(("", "\r", "  \x0c")) for x in lines]
        rng.shuffle(lines)
        rows.append((i, "\n".join([*lines, "A line that every one of them holds"] if i % 3 == 0 else lines)))
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, f"{pool[3]}\nnothing else"), (None, f"{pool[4]}\nmore"), (7, f"again seven\n{pool[5]}"), rows[9], rows[9], (403, "z" * 200_000), (404, "\n".join(f"{pool[0]}" for _ in range(5000)))]
    # one id in three rows isn't three documents; two documents aren't enough
    return [*rows, *[(500, "a line of one document in three rows")] * 3, (501, "a line of two documents, no more"), (502, "a line of two documents, no more")]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (3, 2), (7, 2)])
def test_rows(spark, batches, fanout):
    rows = cases()
    docs = spark.createDataFrame([(*x, 5, "k", 3, True) for x in rows], SCHEMA).repartition(3)
    out = linededup.dedup_lines(docs, Shelf(spark, "test"), batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert Counter(map(tuple, out.collect())) == Counter(by_hand(rows))
    assert sum(x[2] for x in by_hand(rows)) > 500
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lintweave_lines")]


def test_limits(spark):
    """Every line twice or more, whatever its length."""
    rows = [(1, "a\nb\na"), (2, "A \nc"), (3, "c\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.dedup_lines(docs, Shelf(spark, "test"), min_chars=1, min_docs=2)
    assert sorted(map(tuple, out.collect())) == sorted(by_hand(rows, 1, 2)) == [(1, 3, 2, "b"), (2, 2, 1, "A "), (3, 3, 0, "c\n\n")]
    assert linededup.dedup_lines(docs.limit(0), Shelf(spark, "test")).count() == 0


def test_runs(spark):
    """What a batch tells is all that its run holds; levels are compacted; counts below the limit are exact."""
    runs = linededup.LineRuns(Shelf(spark, "test"), min_docs=3, fanout=2)
    batch = lambda *rows: spark.createDataFrame([(h, 0, i) for h, i in rows], "h1 long, h2 long, doc_id long")
    runs.add(batch((1, 10), (1, 11), (1, 12), (2, 10), (3, 5), (3, 5)))
    assert [len(x) for x in runs.levels] == [1]
    runs.add(batch((1, 3), (2, 9), (3, 6)))  # 1 is known by three, with a larger id
    assert [len(x) for x in runs.levels] == [0, 1]
    assert sorted(map(tuple, spark.table(runs.names()[0]).collect())) == [(1, 0, 3, 12), (2, 0, 2, 10), (3, 0, 2, 6)]
    runs.add(batch((1, 2), (4, 1)))
    assert sorted(x.h1 for x in spark.table(runs.levels[0][0]).collect()) == [4]
    runs.add(batch((1, 40), (2, 1)))
    assert [len(x) for x in runs.levels] == [0, 0, 1] and sorted(map(tuple, runs.shared().collect())) == [(1, 0, 40), (2, 0, 10)]
    runs.drop()


def test_runs_are_not_shuffled(spark):
    """A batch meets three runs in merge joins; the only exchanges are those of its own rows."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = linededup.LineRuns(Shelf(spark, "test"), min_docs=1, fanout=9)
        batch = lambda i: spark.range(100).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), (F.col("id") + i).alias("doc_id"))
        for i in range(3):
            runs.add(batch(i))
        news = runs.news(batch(9))
        news.collect()
        plan = news._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan, plan
        runs.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_query(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, "one line that is long enough\nown") for i in range(4)]
    spark.createDataFrame([(*x, 5, "k", 3, True) for x in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()["op11_lines"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in by_hand(rows)]
