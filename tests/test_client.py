"""Calls to services that fail by plan: what is asked how often, and what is kept."""

import random

import pytest

from lintweave.operators import client

FAST = client.Policy(pause=0.0, batch=8, chars=200)


def upper(texts):
    return [t.upper() for t in texts]


def test_splits():
    rng = random.Random(4)
    for _ in range(200):
        texts = ["".join(rng.choice("abxyz") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 40))]
        asked = []

        def transport(some):
            asked.append(len(some))
            assert len(some) <= 8 and (len(some) == 1 or sum(map(len, some)) <= 200)
            if any("xy" in t for t in some):
                raise client.Refused("xy")
            return upper(some)

        got = list(client.each(transport, texts, FAST))
        assert got == [(None, "Refused: xy", True) if "xy" in t else (t.upper(), None, True) for t in texts]
        assert len(asked) <= 2 * len(texts) + 1


def test_tries():
    calls = []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) % 3:
            raise TimeoutError("slow") if len(calls) % 3 == 1 else ValueError
        return upper(texts)

    assert [x[0] for x in client.each(flaky, ["a", "b"], FAST)] == ["A", "B"] and len(calls) == 3
    short = lambda texts: upper(texts)[1:] if len(texts) > 1 or texts == ["c"] else upper(texts)
    got = list(client.each(short, ["a", "b", "c"], FAST))
    assert [x[0] for x in got] == ["A", "B", None] and got[2][1].startswith("Malformed") and not got[2][2]
    gone = lambda texts: upper(texts) if "e" not in texts else (_ for _ in ()).throw(client.Stop("key"))
    one = client.Policy(pause=0.0, batch=1)
    assert list(client.each(gone, ["d", "e", "f"], one)) == [("D", None, True), (None, "Stop: key", False), (None, "Stop: key", False)]


def test_statuses():
    make = lambda status, body: client.vectors(lambda p: (status, body), "m", 2)
    assert make(200, {"embeddings": [[1, 2]]})(["a"]) == [[1.0, 2.0]]
    for status, body, error in ((401, None, client.Stop), (422, None, client.Refused), (429, None, ConnectionError), (503, None, ConnectionError), (200, [], client.Malformed), (200, {"embeddings": [[1]]}, client.Malformed)):
        with pytest.raises(error):
            make(status, body)(["a"])
    ask = client.decisions(lambda p: (200, {"answers": {"q": p["state"]}} if p["state"] else {}), "m", {"q": {}})
    assert ask(["b", "a"]) == ['{"q": "b"}', '{"q": "a"}']
    with pytest.raises(client.Malformed):
        ask([""])


def logged(folder, fails=None):
    """Upper case; every text that is answered is noted in a file, so that processes and runs share the record."""

    def transport(texts):
        if fails and any(t in fails for t in texts):
            raise ConnectionError("down")
        with open(f"{folder}/log", "a") as out:
            out.write("".join(t + "\n" for t in texts))
        # a function of this module isn't known to workers
        return [t.upper() for t in texts]

    return transport


def test_restart(spark, tmp_path):
    texts = [f"t{i % 60}" for i in range(400)] + ["hot"] * 200 + [None, None]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, key string").repartition(5)
    kept = client.Answers(spark, str(tmp_path / "store"), "string")
    policy = client.Policy(tries=2, pause=0.0, batch=3)
    left = kept.ask(rows, logged(tmp_path, {"t7"}), policy=policy)
    assert 0 < left < 61
    before = {r.id: r.answer for r in kept.answered(rows).collect()}
    assert all(before[i] in (None, (t or "").upper()) for i, t in enumerate(texts)) and before[7] is None
    # another session of the same store: only what is open is asked
    again = client.Answers(spark, str(tmp_path / "store"), "string")
    assert again.ask(rows, logged(tmp_path), policy=policy) == 0
    assert again.ask(rows, logged(tmp_path), policy=policy) == 0
    asked = (tmp_path / "log").read_text().split()
    assert sorted(asked) == sorted({t for t in texts if t})
    got = again.answered(rows)
    assert got.columns == ["id", "text", "key", "answer", "error"]
    assert {r.id: (r.answer, r.error) for r in got.collect()} == {i: (t and t.upper(), None) for i, t in enumerate(texts)}
    empty = rows.limit(0)
    assert kept.ask(empty, logged(tmp_path)) == 0 and kept.answered(empty).count() == 0


def test_embedded(spark, tmp_path):
    sections = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "bad"), ("d", "two"), ("e", None)], "section_id string, text string")
    digest = client.F.sha2("text", 256)
    stored = sections.filter("section_id IN ('a', 'b')").select("section_id", client.F.when(client.F.col("section_id") == "a", digest).otherwise("old").alias("digest"), client.F.array(client.F.lit(0.5)).alias("vector"))
    stored = stored.unionByName(spark.createDataFrame([("gone", "x", [1.0])], stored.schema))
    post = lambda p: (400, None) if "bad" in p["input"] else (200, {"embeddings": [[float(len(t))] for t in p["input"]]})
    found = client.embedded(sections, stored, client.Answers(spark, str(tmp_path), "array<double>"), client.vectors(post, "m", 1), policy=FAST)
    assert sorted((r.section_id, r.vector) for r in found.collect()) == [("a", [0.5]), ("b", [3.0]), ("d", [3.0])]
