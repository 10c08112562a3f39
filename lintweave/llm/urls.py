"""Operator 8: URL filters by the ratio of two character language models.

Rules (host, path, verdict) come first: a rule fits its host and all subdomains if the url's path starts with the rule's
path, and the longest rule (host, then path) wins. Urls that a rule judges train two smoothed variable-order Markov
models, one of allowed and one of blocked urls: exact counts of characters after contexts of length 0 to ORDER,
interpolated from short to long contexts with Witten-Bell weights. Other urls get the
difference of the models' log-likelihoods per character, with digits folded to one sign; the threshold is calibrated on the trained urls' scores, as the bin edge with
the fewest errors weighted by class, ties to the one nearest zero.

Counts cover all rows and stay in Spark tables: runs of ORDER + 1 bytes with their counts, which the distinct runs of all
urls are joined with, and the urls with those. Only tables of contexts of up to two bytes are broadcast. Null urls and urls without "://" have an empty host and path. Without training urls of both kinds all scores are
0 and the verdict is allow. Repeated rows count each time. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 4
#: Scores are calibrated on bins of this width between -LIMIT and LIMIT.
BIN, LIMIT = 0.05, 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, by_rule): the rule that wins, and its verdict."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    chosen = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        chosen, verdict = F.when(fits, F.lit(h + p)).otherwise(chosen), F.when(fits, F.lit(v)).otherwise(verdict)
    return parts.select("page_id", "host", "path", chosen.alias("rule"), verdict.alias("by_rule"))


def _codes(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all urls, one after the other with an end sign each, digits folded, and the url of each byte."""
    texts = [(h + p + "\n").encode() for h, p in zip(hosts, paths, strict=True)]
    data = np.frombuffer(b"".join(texts), np.uint8).copy()
    data[(data >= 48) & (data <= 57)] = 48
    return data, np.repeat(np.arange(len(texts)), [len(x) for x in texts])


def grams(urls: DataFrame) -> DataFrame:
    """(url_id, gram, n) of (url_id, host, path): a url's runs of ORDER + 1 bytes as one number; the first ones are padded."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                data, owner = _codes(part.column(1).to_pylist(), part.column(2).to_pylist())
                gram = data.astype(np.int64)
                for k in range(1, ORDER + 1):
                    before = np.full(len(data), 10, np.int64)
                    same = owner[k:] == owner[:-k]
                    before[k:][same] = data[:-k][same]
                    gram |= before << (8 * k)
                order = np.lexsort((gram, owner))
                gram, owner = gram[order], owner[order]
                at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])) if len(gram) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([at, [len(gram)]]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[at])), pa.array(gram[at]), pa.array(n.astype(np.int64))], ["url_id", "gram", "n"])

    return urls.select("url_id", "host", "path").mapInArrow(run, "url_id long, gram long, n long")


def ratios(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) of the grams wanted: log-likelihood of allow less that of block, by known (gram, n0, n1)."""
    out = wanted.select("gram", F.lit(1 / 256).alias("p0"), F.lit(1 / 256).alias("p1"))
    for k in range(ORDER + 1):
        key = F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)
        full = known.groupBy(key.alias("full")).agg(F.sum("n0").alias("f0"), F.sum("n1").alias("f1"))
        of = F.shiftright("full", 8)
        context = full.groupBy(of.alias("context")).agg(*(F.sum(f"f{c}").alias(f"c{c}") for c in (0, 1)), *(F.sum((F.col(f"f{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)))
        # 65,536 contexts at most
        context = F.broadcast(context) if k <= 2 else context
        out = out.withColumn("full", key).withColumn("context", F.shiftright(key, 8))
        out = out.join(F.broadcast(full) if k <= 1 else full, "full", "left").join(context, "context", "left")
        p = (F.when(F.col(f"c{c}") > 0, (F.coalesce(f"f{c}", F.lit(0)) + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"c{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1))
        out = out.select("gram", *p)
    return out.select("gram", (F.log("p0") - F.log("p1")).alias("ratio"))


def threshold(histogram: list[tuple[int, str, int]]) -> float:
    """The bin edge at which shares of wrongly judged allowed and blocked urls add up to the least."""
    by = {"allow": {}, "block": {}}
    for b, verdict, n in histogram:
        by[verdict][b] = by[verdict].get(b, 0) + n
    total = {k: sum(v.values()) or 1 for k, v in by.items()}
    edges = sorted({b for v in by.values() for b in v} | {0})
    wrong = lambda e: sum(n for b, n in by["allow"].items() if b < e) / total["allow"] + sum(n for b, n in by["block"].items() if b >= e) / total["block"]
    return min(edges, key=lambda e: (round(wrong(e), 12), abs(e), e)) * BIN


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages."""
    spark = pages.sparkSession
    judged = ruled(pages, rules, id_col, url_col)
    shelf = Shelf(spark, "op8")
    urls = judged.groupBy("host", "path").agg(*(F.sum((F.col("by_rule") == v).cast("long")).alias(f"t{c}") for c, v in enumerate(("allow", "block"))))
    urls = shelf.put(urls.withColumn("url_id", F.monotonically_increasing_id()), "urls")
    total = urls.agg(F.sum("t0"), F.sum("t1")).first()
    trained = bool(total[0] and total[1])
    scored = judged.withColumn("score", F.lit(0.0))
    if trained:
        own = shelf.put(grams(urls), "grams")
        counted = own.join(urls.select("url_id", F.coalesce("t0", F.lit(0)).alias("t0"), F.coalesce("t1", F.lit(0)).alias("t1")), "url_id")
        known = shelf.put(counted.groupBy("gram").agg(F.sum(F.col("n") * F.col("t0")).alias("n0"), F.sum(F.col("n") * F.col("t1")).alias("n1")), "known")
        values = shelf.put(ratios(known.filter("n0 + n1 > 0"), known), "ratios")
        by_url = own.join(values, "gram").groupBy("url_id").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))
        by_url = shelf.put(urls.join(by_url, "url_id").select("host", "path", "score"), "scores")
        scored = judged.join(by_url, ["host", "path"]).select(*judged.columns, "score")
    edge = 0.0
    if trained:
        binned = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN).cast("int")
        edge = threshold([tuple(r) for r in scored.filter("by_rule IS NOT NULL").groupBy(binned.alias("b"), "by_rule").count().collect()])
    own = F.when(F.col("score") >= F.lit(edge), "allow").otherwise("block") if trained else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), F.round("score", 6).alias("score"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, then by the models."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
