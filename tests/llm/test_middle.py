"""Fill-in-the-middle against units cut by the pattern itself; rank and select against loops."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintweave.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, output string, form string"


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.booleans(), max_size=1400), st.data())
@settings(max_examples=60, deadline=None)
def test_rank_and_select(bits, data):
    own = middle.Bits(np.packbits(np.array(bits, np.bool_), bitorder="little"))
    at = np.array([data.draw(st.integers(0, len(bits))) for _ in range(5)] + [0, len(bits)], np.int64)
    assert own.rank(at).tolist() == [sum(bits[:i]) for i in at]
    ones = [i for i, x in enumerate(bits) if x]
    assert own.select(np.arange(len(ones))).tolist() == ones


@given(st.lists(st.tuples(st.integers(-5, 2000), st.text(alphabet="ab é\U0001f600\n\t\x0b\x0c\r\x1c\x85  <PSM>", max_size=40)), min_size=1, max_size=8), st.sampled_from((64, 1 << 22)))
@settings(max_examples=150, deadline=None)
def test_cuts(rows, chunk):
    kept, middle.CHUNK = middle.CHUNK, chunk
    try:
        got = middle.cuts([t.encode() for _, t in rows], [middle.draws(42, i) for i, _ in rows])
    finally:
        middle.CHUNK = kept
    for (i, t), (n, a, b, prefix, mid) in zip(rows, got, strict=True):
        units, h = UNIT.findall(t), middle.draws(42, i)
        x, y = sorted(k % (len(units) + 1) for k in h[:2])
        assert n == len(units) and t.encode()[:a].decode() == "".join(units[:x]) and t.encode()[a:b].decode() == "".join(units[x:y])
        assert (prefix, mid) == (len("".join(units[:x])), len("".join(units[x:y])))


def test_rows(spark):
    rows = [(i, f"word{i} \n tail {'é ' * i}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \t "), (903, "x" * 300_000), (904, "a b " * 90_000), (None, "no id here"), (905, "has <S> inside"), (906, "<" * 9), (7, "word7 \n tail " + "é " * 7), (907, " lead")]
    docs = spark.createDataFrame([(i, t, -1, "o", "f") for i, t in rows], SCHEMA).repartition(3)
    made = middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in middle.restored(made).collect()), key=key)
    assert got == sorted(((i, *(x := by_hand(i, t))[:4], sha(x[4]), sha(t or "")) for i, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert middle.restored(middle.fill_in_middle(docs.limit(0))).count() == 0


def test_sentinels():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("ab", "bc", "xy"), ("", "b", "c")):
        with pytest.raises(ValueError):
            middle._sound(bad)
    with pytest.raises(ValueError):
        middle.restore(b"<P>one", "psm")


def test_query(spark, tmp_path):
    """The registered query's columns, over a table with columns that clash."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "one two", 5, "x", "y"), (None, None, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()["op12_middle"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and out.count() == 2
