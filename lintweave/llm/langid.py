"""Operator 2: language identification by inference of multilingual mixtures.

Training counts hashed character n-grams (1 to ORDER, of letters with word ends) by language, over all labelled rows;
the model is BUCKETS numbers for each language. A document is a sequence of words; each word's likelihood in each
language is the product of its n-grams'. Expectation-maximisation estimates the document's language proportions. The
language set is chosen by penalised likelihood: the best single language, then more of the languages in the order of
their estimated proportions, as long as a further language raises the log-likelihood by more than its penalty.
The prediction is the language with the largest proportion within the chosen set; the score is that proportion.

Null texts and texts without a letter are `und` with score 0. Without labelled rows all are `und`. Ties go to the
language that sorts first. Repeated rows count each time. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

ORDER = 3
BUCKETS = 1 << 15
#: Log-likelihood that a further language has to win, for each unit of the logarithm of the number of words.
PENALTY = 6.0
STEPS = 6
UNKNOWN = "und"
_END = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, each word after a space and all ended by one; the first place and the text of each word."""
    lowered = [x.lower() for x in texts]
    code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in lowered])
    letter = _letters()[code]
    first = letter & ~np.concatenate([[False], letter[:-1]])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter, or the sign after a word
    code = np.where(letter, code, _END)[keep]
    starts = np.flatnonzero(first[keep])
    return code.astype(np.uint64), starts, text[first]


def grams(code: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that end at each place, by n; one beyond a word's start also holds the sign before it."""
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.full(len(code), _END, np.uint64)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        if n > 2:  # no further than the sign before the word
            shifted[~inside] = _END
        h = (h + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        inside = (shifted != _END) if n > 1 else np.ones(len(code), bool)
        out.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64))
    return out


def train(docs: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket in each) from the rows for which labelled holds."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in slices(batch):
                lang = np.array(part.column(0).to_pylist(), object)
                for name in set(lang):
                    code, starts, _ = words([t for t, x in zip(texts, lang, strict=True) if x == name])
                    sums = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for b in grams(code):
                        sums += np.bincount(b, minlength=BUCKETS)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "bucket", "n"])

    rows = docs.filter(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # bounded by the number of languages times BUCKETS
    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(names)), 0.5)
    for i, name in enumerate(names):
        own = found[found["lang"] == name]
        counts[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32) if names else counts


def mixture(likely: np.ndarray, text: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text, and the log-likelihood; likely: words by languages, text: ascending."""
    n = len(allowed)
    size = np.bincount(text, minlength=n)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    starts = np.searchsorted(text, np.arange(n))
    have = size > 0
    total = np.zeros(n)
    for _ in range(steps):
        weighted = likely * share[text]
        each = weighted.sum(axis=1, keepdims=True) + 1e-30
        total[have] = np.add.reduceat(np.log(each[:, 0]), starts[have])
        weighted /= each
        share[have] = np.add.reduceat(weighted, starts[have], axis=0) / size[have, None]
    return share, total


def predict_texts(texts: list[str], names: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    code, starts, text = words(texts)
    if not len(starts) or not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    per = sum(logs[b] for b in grams(code))
    by_word = np.add.reduceat(per, starts, axis=0)
    likely = np.exp(np.maximum(by_word - by_word.max(axis=1, keepdims=True), -30)).astype(np.float64)
    n, k = len(texts), len(names)
    size = np.bincount(text, minlength=n)
    share, _ = mixture(likely, text, np.ones((n, k)))
    rank = np.argsort(-share, axis=1, kind="stable")
    single = np.stack([np.bincount(text, np.log(likely[:, i]), n) for i in range(k)], axis=1)
    # the best single language: by its likelihood alone
    lead = single.argmax(axis=1)
    rank = np.stack([np.concatenate([[a], r[r != a]]) for a, r in zip(lead, rank, strict=True)])
    best = single[np.arange(n), lead]
    chosen = np.zeros((n, k))
    chosen[np.arange(n), lead] = 1
    final = chosen.copy()
    going = size > 0
    for m in range(1, k):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        own = np.flatnonzero(going[text])
        index = np.cumsum(going) - 1
        wider = chosen[rows].copy()
        wider[np.arange(len(rows)), rank[rows, m]] = 1
        part, ll = mixture(likely[own], index[text[own]], wider)
        better = ll - best[rows] > PENALTY * np.log1p(size[rows])
        won = rows[better]
        chosen[won], final[won], best[won] = wider[better], part[better], ll[better]
        going[:] = False
        going[won] = True
    top = final.argmax(axis=1)
    score = np.clip(final[np.arange(n), top], 0, 1)
    return [names[i] if s else UNKNOWN for i, s in zip(top, size, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, size, strict=True)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more, named by out, which replace any of these names; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text_col):
                names, score = predict_texts(texts, *sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *out])

    kept = docs.select(*(c for c in docs.columns if c not in out))
    return kept.mapInArrow(run, f"{kept._jdf.schema().toDDL()}, `{out[0]}` string, `{out[1]}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that a model may not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
