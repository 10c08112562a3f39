"""Each operator against brute force or a round trip, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import json
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintweave.llm import blocknames, bpe, langid, licenses, neardup, ogg, packing, passages, pii, urls
from lintweave.llm.common import Shelf

LONG = "A long text, with words: " * 9000
ROWS = [(1, "Hello wörld  \n again"), (2, None), (3, ""), (4, LONG), (5, "x" * 200_000), (6, "same text here for all"), (7, "same text here for all"), (8, "same text here for all"), (9, " " * 70_000 + "end"), (10, "<|endoftext|> 12345 don't"), (11, "\ud7ff\x1c\u2028 \u0085 a"), (12, "one")]
SCHEMA = "doc_id long, text string, kept boolean, score double, name string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, False, 9.0, "n") for i, t in [*ROWS, ROWS[5]]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def matches_encoded(text):
    """By the pattern's matches, each merged on its own."""
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in enc._core_bpe.encode_single_piece(m[0].encode())]


def test_bpe(table, empty):
    path = public_tokenizers.path(bpe.RANKS)
    rows = bpe.decode(bpe.encode(table, path), path).collect()
    assert len(rows) == len(ROWS) + 1
    texts = dict(ROWS)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode()
        assert [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] == matches_encoded(text)
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


@given(st.text(alphabet="ab1 \n'.é\u2028", max_size=200))
@settings(max_examples=60, deadline=None)
def test_bpe_parts(text):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    cut = list(bpe.parts(text, 7))
    assert "".join(cut) == text
    assert [i for x in cut for i in enc.encode_ordinary(x)] == enc.encode_ordinary(text)


def test_langid(spark, table, empty):
    train = [(i, t, lang) for i in range(40) for lang, t in (("en", f"the house and the water {i} is there"), ("de", f"das haus und die straße {i} ist schön"))]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), langid.held_out())
    assert model[0] == ["de", "en"]
    names, score = langid.predict_texts(["the water is there", "die straße ist schön und", "12 !!", "", "the house and the water is there " * 9 + "das haus und die straße ist schön " * 3], *model)
    assert names == ["en", "de", "und", "und", "en"] and score[2] == 0.0 and 0.6 < score[4] < 0.9
    rows = langid.predict(table, model).collect()
    assert len(rows) == 13 and {r.lang_pred for r in rows if r.doc_id in (2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(empty, langid.train(empty.withColumn("lang", empty.name), langid.held_out())).count() == 0


def dice_by_hand(text, name):
    """The largest coefficient of the whole text or a line with a template of a licence."""
    grams = lambda t: set(zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:]))
    return max(2 * len(grams(u) & grams(t)) / max(1, len(grams(u)) + len(grams(t))) for u in (text, *text.split("\n")) for t in licenses.TEMPLATES[name])


def test_licenses(spark, table, empty):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = licenses.scan_text(f"Some prose before it.\n{t}\nAnd after.")
            assert name in {x[0] for x in found}
            assert dict((x[0], x[1]) for x in found)[name] >= licenses.THRESHOLD <= dice_by_hand(t, name)
    assert licenses.scan_text("A work of prose under the bridge, granted.") == []
    assert [x[0] for x in licenses.scan_text("words before Released under the MIT License. words after it")] == ["MIT"]
    assert licenses.scan(table).count() == 13 and licenses.scan(empty).count() == 0


def base_by_hand(text):
    """The base patterns as written."""
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a1.@+-_% ()5432é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_pii_base(text):
    base, more = pii.spans(text)
    assert base == base_by_hand(text)
    assert set(base) <= set(more)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("write to jo at mail dot example dot org", "email", "jo at mail dot example dot org"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("ip 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"), ("pay ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
        ("call +1 five five five two two two one two three four", "phone", "+1 five five five two two two one two three four"), ("jo\u200be@exam\u200bple.com", "email", "jo\u200be@exam\u200bple.com"),
    ],
)
def test_pii_disguised(text, kind, part):
    assert (kind, text.index(part), text.index(part) + len(part)) in pii.spans(text)[1]
    assert part not in pii.masked(text)


def test_pii_table(table, empty):
    assert pii.spans("we met at noon, dot by dot, one two three") == ([], [])
    rows = pii.detect(table).collect()
    assert len(rows) == 13 and all(r.all == [] for r in rows)
    assert pii.mask(table).columns == table.columns and pii.mask(table).filter("text IS NULL").count() == 1 and pii.mask(empty).count() == 0
    assert pii.find("9" * 300_000 + "a@" * 50_000 + "1.2.3.4")["ip"]


def test_blocknames(spark, table, empty):
    rows = blocknames.exact_groups(table, Shelf(spark, "t5")).collect()
    assert len(rows) == 13
    texts = {i: t or "" for i, t in ROWS}
    groups = defaultdict(list)
    for r in rows:
        groups[texts[r.doc_id]].append(r.doc_id)
    for r in rows:
        own = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert blocknames.exact_groups(empty, Shelf(spark, "t5")).count() == 0
    # small blocks: many levels, texts that differ in one place only
    many = spark.createDataFrame([(i, "ab" * 50 + str(i // 2) + "c" * (i // 4)) for i in range(12)], "doc_id long, text string")
    named = blocknames.identities(many, Shelf(spark, "t5"), block=4).collect()
    assert len({(r.n_blocks, r.name) for r in named}) == 6
    # names are ranks of contents, whatever the partitions
    repeated = table.union(table.repartition(7)).union(table.filter("doc_id < 6"))
    for n, docs in ((1, table), (3, repeated.coalesce(2)), (8, repeated.repartition(9))):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        once = {(r.n_blocks, r.name, r.text_sha256) for r in blocknames.identities(docs, Shelf(spark, "t5")).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(once) == len(set(texts.values()))
        assert n == 1 or once == first
        first = once
    short = sorted(f"text {i * 37 % 50:03d}" for i in range(50))
    copies = spark.createDataFrame([(i, short[i % 50]) for i in range(400)], "doc_id long, text string").repartition(6)
    assert {(r.name, short[r.doc_id % 50]) for r in blocknames.identities(copies, Shelf(spark, "t5")).collect()} == set(enumerate(short))
    # small ranges aren't joined from here on, so that there are several
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    assert {(r.name, short[r.doc_id % 50]) for r in blocknames.identities(copies, Shelf(spark, "t5")).collect()} == set(enumerate(short))
    # every block has the same first bytes and the same hash: ranges that meet are dealt again by contents
    long = ["the same opening of all " + x for x in short]
    alike = spark.createDataFrame([(i, long[i % 50]) for i in range(400)], "doc_id long, text string").repartition(6)
    shelf = Shelf(spark, "t5")
    same = blocknames.identities(alike, shelf, hashed=lambda _: F.lit(7).cast("long")).collect()
    assert {(r.name, long[r.doc_id % 50]) for r in same} == set(enumerate(long)) and "level0-whole" in shelf.names
    # one block in all rows: ranges meet within it and nothing is dealt again
    shelf = Shelf(spark, "t5")
    hot = spark.createDataFrame([(i, "hot") for i in range(400)], "doc_id long, text string").repartition(6)
    made = blocknames.identities(hot, shelf)
    assert {r.name for r in made.collect()} == {0} and made.count() == 400 and "level0-whole" not in shelf.names
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_neardup(spark, table, empty):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(60)] = rnd.choice(words)
            rows.append((len(rows) + g, " ".join(w)))
    # one key, many copies at and around the threshold: strays of the smallest class that link with each other only
    base = [rnd.choice(words) for _ in range(80)]
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(80), 1 + i % 9):
            w[k] = f"v{i // 2}" if i % 3 else rnd.choice(words)
        rows.append((1000 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "Word"), (903, "word "), (904, "a b"), (905, "a b a b")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), Shelf(spark, "t6"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert neardup.near_groups(table, Shelf(spark, "t6"), width=2).filter("doc_id IN (6, 7, 8)").select("component_id").distinct().collect() == [(6,)]
    assert neardup.near_groups(empty, Shelf(spark, "t6")).count() == 0


def test_neardup_components_meet_first(spark):
    import random

    rnd = random.Random(5)
    kinds = "b long, shingle long, a long, x long, n long, cost long, slack long"
    row = lambda i: (rnd.randrange(2), rnd.randrange(3), i, rnd.choice([0, 0, 0, 1, 2, i]), rnd.randrange(50, 90), rnd.randrange(-400, 400), rnd.randrange(-400, 400))
    left, right = [row(i) for i in range(60)], [row(i) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, kinds)
    want = set()
    for b, s, a, x, n, cost, slack in left:
        for c, t, o, z, m, cost_z, slack_z in right:
            if (b, s) == (c, t) and a != o and x != z and slack >= cost_z and slack_z >= cost and min(n, m) * 100 >= max(n, m) * 80:
                want.add((max(a, o), min(a, o)))
    assert want and {tuple(r) for r in neardup.met(frame(left), frame(right), Shelf(spark, "t6"), "some").collect()} == want
    # pairs that are enumerated, by both sides of each key: two large components that can't meet and one stray that can meet one
    for size in (900, 1800, 3600):
        rows = [(0, s, 10 * i + s, i % 2, 80, 300, 100 + 200 * (i % 2)) for i in range(size) for s in range(3)]
        stray = [(0, s, 10 * size + s, 7, 80, 100, 400) for s in range(3)]
        both = frame(rows + stray)
        ours, theirs = neardup.opposed(both, both, Shelf(spark, "t6"), "many", 80)
        key = ["b", "shingle", "x", "z"]
        sides = ours.groupBy(key).agg(F.count(F.lit(1)).alias("l")).join(theirs.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key)
        # 2 directions, 3 shingles, both components with the stray
        assert sides.agg(F.sum(F.col("l") * F.col("r"))).first()[0] == 2 * 3 * size


def test_packing(spark, table, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rows = packing.pack(table, path, Shelf(spark, "t7")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in ROWS:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]})
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        assert own == [(k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for held in full.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, path, Shelf(spark, "t7")).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=150, deadline=None)
def test_plan(counts):
    planned = packing.plan(counts, 64)
    used = defaultdict(int)
    for lengths, times in planned:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(n for _, n in planned) <= 1.25 * fewest(counts, 64) + 2


def fewest(counts, room):
    """A number of sequences that no packing can do without: pieces over half the room lie apart; those of at least a go
    beside them or among themselves, by their tokens and by their number."""
    best = -(-sum(k * v for k, v in counts.items()) // room)
    for a in range(1, room // 2 + 1):
        alone = sum(v for x, v in counts.items() if x > room - a)
        open_ = [(x, v) for x, v in counts.items() if room // 2 < x <= room - a]
        small = [(x, v) for x, v in counts.items() if a <= x <= room // 2]
        tokens = sum(x * v for x, v in small) - sum((room - x) * v for x, v in open_)
        number = sum(v for _, v in small) - sum((room - x) // a * v for x, v in open_)
        best = max(best, alone + sum(v for _, v in open_) + max(0, -(-tokens // room), -(-number // (room // a))))
    return best


def test_added_tokens():
    """Ids are those of the tokenizers library as it comes: its added tokens have ids of their own."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, enc = Tokenizer.from_file(path), packing.bpe_of_json(path)
    long = ("some words and\n\n<|endoftext|> more <|endoftext|>" * 3000) + " end"
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext| >", "<|endoftext", "plain", "", long):
        assert bpe.encode_text(enc, text, special=True).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert len(bpe.encode_text(enc, "a <|endoftext|> b", special=True)) == 4


def test_urls(spark):
    pages = [(1, "https://EXAMPLE.com/en/x"), (2, "http://www.example.com/en/"), (3, "http://a.example.com/en"), (4, "ftp://x.net/fr/?q#a"), (5, None), (6, "no scheme"), (7, "http://notexample.com/en/"), (8, "http://b.org?x"), (9, "a://://c.net/es/1"), (10, ""), (8, "http://b.org?x")]
    rows = urls.judge(spark.createDataFrame([(i, u, 0, "h", "r") for i, u in pages], "page_id long, url string, score int, host string, rule string")).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows}
    assert len(rows) == 11 and all(r.verdict in ("allow", "block") for r in rows)
    assert got == {
        1: ("example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("a.example.com", "/en", "com/", "allow"),
        4: ("x.net", "/fr/", "net/fr/", "block"), 5: ("", "", None, None), 6: ("", "", None, None), 7: ("notexample.com", "/en/", "com/", "allow"), 8: ("b.org", "", None, None),
        9: (":", "//c.net/es/1", None, None), 10: ("", "", None, None),
    }
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models(spark):
    pages = [(i, f"http://shop{i}.com/buy/now") for i in range(200)] + [(1000 + i, f"http://x{i}.net/es/noticias/gratis") for i in range(200)] + [(5000, "http://shop.org/buy/now"), (5001, "http://x.org/es/noticias/gratis")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).filter("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_passages(spark, table, empty):
    import random

    rnd = random.Random(5)
    prose = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}" for _ in range(n)]
    shared = prose(60)
    fuzzy = [w if k % 15 else "other" for k, w in enumerate(shared)]
    rows = [(1, prose(80) + shared + prose(30)), (2, prose(20) + shared), (3, prose(100)), (4, prose(10) + fuzzy + prose(10)), (5, shared[:30] + prose(90)), (6, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(7, None)], "doc_id long, text string")
    got = passages.repeats(docs, Shelf(spark, "t9")).collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and {(r.doc_id, r.partner_id) for r in got} == {(1, 2), (2, 1), (1, 4), (4, 1)}
    text = {i: " ".join(w).encode() for i, w in rows}
    exact = next(r for r in got if (r.doc_id, r.partner_id) == (2, 1))
    assert text[2][exact.start : exact.end] == text[1][exact.partner_start : exact.partner_end] == " ".join(shared).encode() and exact.similarity == 1.0
    assert passages.repeats(table, Shelf(spark, "t9")).filter("doc_id = partner_id").count() == 0
    assert passages.repeats(empty, Shelf(spark, "t9")).count() == 0


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert passages.common(a, b) == best[-1][-1]


@given(st.binary(min_size=0, max_size=60_000))
@settings(max_examples=30, deadline=None)
def test_ogg(raw):
    payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
    data = ogg.write(payload)
    back, facts = ogg.read(data)
    assert back == payload and facts["samples"] == len(payload) and facts["streams"] == 2
    with pytest.raises(ValueError):
        ogg.read(data[:-1] + bytes([data[-1] ^ 1]))


def test_ogg_lacing():
    """Packets of several lacing values, cut by page ends; granules; pages that go on without need or don't."""
    payload = bytes(i * 7 % 251 for i in range(768 * 200 + 192))
    data = ogg.write(payload)
    back, facts = ogg.read(data)
    assert back == payload and facts["packets"] == 201 and facts["samples"] == len(payload)
    at, flags, granules = 0, [], []
    while at < len(data):
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        flags.append(data[at + 5])
        granules.append(int.from_bytes(data[at + 6 : at + 14], "little", signed=True))
        assert n == 1 or 255 in lacing
        at += 27 + n + sum(lacing)
    assert any(x & 1 for x in flags) and [x & 4 for x in flags[-2:]] == [4, 4] and max(granules) == 768 * 100 + 192
    # a packet longer than a page: no packet ends on the page, whose granule is -1
    own = ogg.pages([b"a" * 2000, b"b" * 255, b""], 5, values=3)
    assert [int.from_bytes(x[6:14], "little", signed=True) for x in own] == [-1, -1, 2000, 2255]
    assert [x[5] & 1 for x in own] == [0, 1, 1, 1]
    head, body = data[: data.index(b"OggS", 4)], ogg.pages([b"x" * 10], 1)[0]
    with pytest.raises(ValueError):
        ogg.read(head + ogg._page([10], b"x" * 10, 5, 10, 1, 1))
    with pytest.raises(ValueError):
        ogg.read(head + ogg._page([255], b"x" * 255, 0, -1, 1, 1) + ogg._page([10], b"x" * 10, 4, 10, 1, 2))
    assert ogg.read(head + body)[0] == b"x" * 10


def test_ogg_checksum_and_table(table, empty):
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        return c

    assert ogg.checksum(b"OggS and more") == slow(b"OggS and more")
    rows = ogg.probe(ogg.media(table)).collect()
    texts = {i: (t or "").encode() for i, t in ROWS}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * (r.payload_bytes - len(raw))
        assert r.n_bytes == len(raw) and r.payload_bytes == 192 * max(1, -(-len(raw) // 192)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert len(rows) == 13 and ogg.probe(ogg.media(empty)).count() == 0


def test_rank_files_agree():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path(bpe.RANKS), "rb"))}
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    assert len(ranks) == len(spec["model"]["vocab"])
    assert packing.bpe_of_json(public_tokenizers.path("byte_bpe_50k.json"))._mergeable_ranks == ranks
