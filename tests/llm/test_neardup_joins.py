"""How op6's candidates travel from the signatures' filter to the comparison of full sets."""

import random

from lintweave.llm import neardup
from lintweave.llm.common import Shelf, id_text


def test_candidates_are_joined_with_classes_once(spark):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh") * rnd.randrange(1, 9) for _ in range(80)]
    rows = []
    for i in range(12):
        words = list(base)
        for j in rnd.sample(range(80), i):
            words[j] = f"w{i}-{j}"
        rows.append((i, " ".join(words)))
    shelf = Shelf(spark, "t6")
    source = id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = shelf.put(neardup.sketch(source).selectExpr("doc_id AS id", "doc_id", "set_id", "n_shingles", "sig"), "classes")
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "a long, b long")
    near = shelf.put(neardup.close(pairs, classes), "near")
    links = neardup.compared(near, classes, source)
    # the ids and sets of both come with a candidate: only the texts are joined
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    sets = {i: set(neardup.shingle_sets([t])[0].tolist()) for i, t in rows}
    want = {(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want and {(r.a, r.b) for r in links.collect()} == want
    # pairs that no filter has seen have neither
    assert {(r.a, r.b) for r in neardup.compared(pairs, classes, source).collect()} == want
