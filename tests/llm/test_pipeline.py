"""The pipeline's stages against plain Python on a small table."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

EN = "the house by the water is old and the people in it are kind to all who come there in the winter when it is cold and dark outside"
DE = "das haus am wasser ist alt und die leute darin sind freundlich zu allen die dort im winter kommen wenn es draussen kalt und dunkel ist"


def rows():
    out = [(i, f"{EN} number {'abcdefghij'[i % 10]} {' '.join(EN.split()[i:])} end", "en") for i in range(20)]
    out += [(100 + i, f"{DE} nummer {'abcdefghij'[i % 10]} {' '.join(DE.split()[i:])} ende", "de") for i in range(20)]
    out += [(200, out[0][1], "en"), (201, out[0][1], None), (202, "12 34 !!", "en"), (203, None, "en"), (204, "", None), (205, EN + " write to jo [at] example [dot] com or jo@example.com", "en")]
    return [(i, t, lang, "s", len(t or ""), i * 2) for i, t, lang in out]


def near_by_hand(docs):
    """Smallest ids of components at 80 % of five-word shingles, the width that is asked of pipeline stages."""
    words = {i: re.findall(r"\S+", t.lower()) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    up = {i: i for i in docs}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i in docs if root(i) == i}


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id long"
    docs = spark.createDataFrame(rows(), schema).repartition(3)
    texts = {i: t for i, t, *_ in rows() if t and re.search("[a-z]", t)}
    largest = {t: i for i, t in sorted(texts.items())}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packed":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id"]
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert ids("language") == set(texts)
    assert ids("exact") == set(largest.values())
    kept = near_by_hand({i: texts[i] for i in ids("exact")})
    assert ids("near") == kept
    private = {r.doc_id: r for r in seen["private"].collect()}
    assert set(private) == kept
    masked = next(r for r in private.values() if "EMAIL" in r.text) if 205 in kept else None
    assert masked is None or masked.text.endswith("write to <EMAIL> or <EMAIL>") and masked.n_chars == len(masked.text)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = seen["packed"].collect()
    assert {r.doc_id: r.length for r in packed} == {i: len(slow.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in private.items()}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_not_ids(spark):
    """Stages decide by row: ids that repeat with other texts, null ids and texts, columns with clashing names."""
    schema = "doc_id long, text string, _own_id string, _lang_pred string, text_sha256 string, component_id long"
    table = [(5, "x same"), (5, "unique"), (9, "x same"), (None, "no id here"), (7, None), (8, ""), (None, "x same")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in table], schema)
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.exact(spark, docs, "").collect())
    assert kept == [(0, "no id here"), (5, "unique"), (8, ""), (9, "x same")]
    text = EN + " " + DE
    table = [(5, text), (5, "unique words of its own"), (9, text + " end"), (None, text.upper()), (None, "no id here"), (7, None), (8, ""), (3, text + " too")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in table], schema)
    out = corpus_pipeline.near(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "no id here"), (3, text + " too"), (5, "unique words of its own"), (7, ""), (8, "")]
    labelled = docs.select("*", F.lit("en").alias("lang"), F.lit(0.5).alias("_lang_score"))
    spoken = corpus_pipeline.language(spark, labelled, "")
    assert spoken.columns == labelled.columns and spoken.filter("text IS NULL OR text = ''").count() == 0
    assert spoken.filter("_lang_pred <> 'b'").count() == 0
