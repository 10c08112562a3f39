"""Pruned cosine joins against all pairs."""

import math

import numpy as np
import pytest

from lintweave.operators import vectors


def clustered(rng, clusters, each, dim, noise):
    centres = rng.normal(size=(clusters, dim))
    return [(int(i), (centres[i % clusters] + noise * rng.normal(size=dim)).tolist()) for i in range(clusters * each)]


def all_pairs(rows, threshold):
    out = {}
    known = [(i, np.array(v, float)) for i, v in rows if v and None not in v and not any(map(math.isnan, v)) and any(v)]
    for k, (i, x) in enumerate(known):
        for j, y in known[k + 1 :]:
            if len(x) == len(y) and (s := float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y))) >= threshold:
                out[min(i, j), max(i, j)] = s
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)


@pytest.mark.parametrize("threshold", [0.99, 0.7, 0.2, -0.3])
def test_equals_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 6, 25, 8, 0.3) + [(i + 200, rng.normal(size=8).tolist()) for i in range(60)] + [(i + 300, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None, 2.0]), (404, [float("nan")] * 8), (405, rows[0][1]), (406, [-x for x in rows[0][1]]), (407, [1e200 * x for x in rows[1][1]]), (408, [2.0]), (409, [3.0]), (410, [-1.0])]
    rows = [r for r in rows if r[0] != 407]
    got = {(r.a, r.b): r.similarity for r in vectors.cosine_pairs(frame(spark, rows), threshold, block_rows=16, pivots=8).collect()}
    want = all_pairs(rows, threshold)
    close = {k for k, s in want.items() if abs(s - threshold) > 1e-9}
    assert close <= set(got) and all(abs(got[k] - want.get(k, threshold)) < 1e-9 for k in got)


def test_few_blocks_compared(spark):
    rng = np.random.default_rng(5)
    made = vectors.blocks(frame(spark, clustered(rng, 24, 40, 32, 0.05)), 0.95, block_rows=20, pivots=32)
    n, compared = made.summary.count(), made.pairs.count()
    assert n >= 24 and compared * 10 < n * (n + 1) // 2
    assert made.rows.groupBy("own").count().agg({"count": "max"}).first()[0] < 60


def test_one_block_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    assert {(r.a, r.b) for r in vectors.cosine_pairs(frame(spark, rows), 0.9).collect()} == {(1, 2)}
    assert vectors.cosine_pairs(frame(spark, []), 0.9).count() == 0


def test_terms_and_sections(spark):
    terms = spark.createDataFrame([("Cache", [1.0, 0.0]), ("cache", [1.0, 0.0]), ("CACHES", [1.0, 0.01]), ("task", [0.0, 1.0])], "term string, vector array<float>")
    assert [(r.term_a, r.term_b, r.similarity) for r in vectors.similar_terms(terms, 0.5).collect()] == [("CACHES", "Cache", 1.0), ("CACHES", "cache", 1.0)]
    assert vectors.similar_terms(terms, 0.5, most=1).count() == 1
    body = "x" * 60
    rows = [("s1", "a.md", body, [1.0, 0.0]), ("s2", "a.md", body, [1.0, 0.0]), ("s3", "b.md", body, [1.0, 0.2]), ("s4", "b.md", " " + body[1:] + "　", [1.0, 0.0]), ("s5", "c.md", None, [1.0, 0.0])]
    sections = spark.createDataFrame(rows, "section_id string, path string, body string, vector array<double>")
    assert [(r.section_a, r.section_b, r.path_a, r.path_b) for r in vectors.similar_sections(sections, 0.9).collect()] == [("s1", "s3", "a.md", "b.md"), ("s2", "s3", "a.md", "b.md")]


def test_copies_sent_grow_with_rows(spark):
    """However small blocks are asked for, a row isn't sent to more of them as the table grows."""
    rng = np.random.default_rng(7)
    sent = []
    for n in (2000, 8000):
        made = vectors.blocks(frame(spark, [(i, rng.normal(size=8).tolist()) for i in range(n)]), 0.3, block_rows=16, pivots=4)
        own = made.rows.groupBy("own").count()
        both = made.pairs.select(vectors.F.explode(vectors.F.array_distinct(vectors.F.array("i", "j"))).alias("own"))
        sent.append(both.join(own, "own").agg({"count": "sum"}).first()[0] / n)
    assert sent[1] < 1.3 * sent[0]


@pytest.mark.parametrize("n", [3000, 9000])
def test_few_short_copies(spark, n):
    """Where angles rule out little, a vector is sent to few blocks, as the floats that it has; labels come with it."""
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)], i % 7) for i in range(n)], "id long, vector array<float>, label int")
    made = vectors.blocks(rows, 0.3, block_rows=64, keep=("label",))
    own = made.rows.groupBy("own").count()
    both = made.pairs.select(vectors.F.explode(vectors.F.array_distinct(vectors.F.array("i", "j"))).alias("own"))
    assert both.join(own, "own").agg({"count": "sum"}).first()[0] < 12 * n
    assert made.rows.schema["vector"].dataType.elementType.simpleString() == "float"
    if n == 3000:
        found = vectors.cosine_pairs(rows, 0.75, block_rows=64, keep=("label",)).collect()
        want = all_pairs([(r.id, r.vector) for r in rows.collect()], 0.75)
        assert {(r.a, r.b) for r in found} == set(want) and len(found) == len(want) > 0
        assert all((r.label_a, r.label_b) == (r.a % 7, r.b % 7) for r in found)


def test_sections_texts_read_once(spark):
    """Pairs know their files: the texts take no part in what is joined and sorted."""
    rows = [(f"s{i}", f"{i % 2}.md", "x" * (58 + i), [1.0, 0.1 * i]) for i in range(5)]
    found = vectors.similar_sections(spark.createDataFrame(rows, "section_id string, path string, body string, vector array<float>"), 0.5)
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.section_a, r.section_b, r.path_a, r.path_b) for r in found.collect()] == [("s3", "s4", "1.md", "0.md"), ("s2", "s3", "0.md", "1.md")]
