"""Model review with an injected provider: what is asked, and what answers come to.

A provider is a function from a list of requests (dicts) to a list of answers (dicts with outcome, severity, score); it
runs on the executors in batches. ``passing`` is one that passes everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintweave.functions.text import half_even

Provider = Callable[[list[dict]], list[dict]]


def passing(requests: list[dict]) -> list[dict]:
    """Passes every request with certainty."""
    return [{"outcome": "pass", "severity": "minor", "score": 1.0} for _ in requests]


def requests(items: DataFrame, checks: DataFrame, per_request: int = 2, budget: int = 16_000) -> DataFrame:
    """(item_id, batch, check_ids, body): each item with its mode's enabled checks, a few to a request; bodies cut with a mark.

    items: (item_id, mode, body); checks: (check_id, mode, enabled). An equi-join on the mode.
    """
    both = items.join(checks.filter("enabled"), "mode")
    order = Window.partitionBy("item_id").orderBy("check_id")
    numbered = both.withColumn("batch", F.floor((F.row_number().over(order) - 1) / per_request).cast("int"))
    body = F.when(F.length("body") > budget, F.concat(F.substring("body", 1, budget), F.lit("\n[truncated]"))).otherwise(F.col("body"))
    return numbered.groupBy("item_id", "batch").agg(F.array_sort(F.collect_list("check_id")).alias("check_ids"), F.first(body).alias("body"))


def ask(asked: DataFrame, provider: Provider = passing, batch_size: int = 32) -> DataFrame:
    """(item_id, check_id, outcome, severity, score): an answer for each check of each request."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            each = [{"item_id": i, "check_id": c, "body": b} for i, cs, b in zip(part["item_id"], part["check_ids"], part["body"], strict=True) for c in cs]
            rows = []
            for k in range(0, len(each), batch_size):
                some = each[k : k + batch_size]
                answers = provider(some)
                if len(answers) != len(some):
                    raise ValueError("a provider must answer every request")
                rows += [(r["item_id"], r["check_id"], a["outcome"], a["severity"], float(a["score"])) for r, a in zip(some, answers, strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "check_id", "outcome", "severity", "score"])

    kind = asked.schema["item_id"].dataType.simpleString()
    return asked.select("item_id", "check_ids", "body").mapInPandas(run, f"item_id {kind}, check_id string, outcome string, severity string, score double")


def severity_of(outcome: Column, severity: Column, score: Column, sure: float = 0.7) -> Column:
    """Severity of an issue, null for none: failures are errors if major and sure, else warnings; missing context is information."""
    return F.when(outcome == "insufficient_context", "INFO").when((outcome == "fail") & (severity == "major") & (score >= sure), "ERROR").when(outcome == "fail", "WARNING")


def status(answers: DataFrame) -> DataFrame:
    """(item_id, status, failed, warned, skipped): FAIL, then WARN, then SKIPPED if all are, else PASS."""
    level = severity_of(F.col("outcome"), F.col("severity"), F.col("score"))
    per = answers.groupBy("item_id").agg(
        F.count_if(level == "ERROR").alias("failed"), F.count_if(level == "WARNING").alias("warned"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("n")
    )
    return per.select("item_id", F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").when(F.col("skipped") == F.col("n"), "SKIPPED").otherwise("PASS").alias("status"), "failed", "warned", "skipped")


def risk(scores: Column) -> Column:
    """A risk of 1 to 5 from a mean of 0 to 4, halves rounded to even; out of range raises."""
    checked = F.when((scores >= 0) & (scores <= 4), scores).otherwise(F.raise_error(F.lit("a score must be from 0 to 4")).cast("double"))
    return F.least(F.lit(5), F.greatest(F.lit(1), half_even(checked) + 1))


def sampled(rows: DataFrame, key: str, order: str, most: int = 4) -> DataFrame:
    """Of each key's rows, at most `most`, evenly spaced in order, the first and last among them: a sampling operator."""
    w = Window.partitionBy(key)
    n = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: half_even(k * (F.col("_n") - 1) / (most - 1)))
    return n.filter((F.col("_n") <= most) | F.array_contains(at, F.col("_i").cast("int"))).drop("_i", "_n")


def variance(judged: DataFrame, least: float = 0.7, backend: str | None = None) -> DataFrame:
    """Pairs of terms (term_a, term_b, is_variance, confidence, backend) judged to be variants, surely enough."""
    found = judged.filter(F.col("is_variance") & (F.col("confidence") >= least))
    return found.filter(F.col("backend") == backend) if backend else found


def unjudged(pairs: DataFrame, judged: DataFrame, backend: str, most: int | None = None) -> DataFrame:
    """Pairs (term_a, term_b, similarity) that a backend hasn't judged, in either order; the most similar first, at most so many."""
    ends = lambda df: df.select("*", F.least("term_a", "term_b").alias("_x"), F.greatest("term_a", "term_b").alias("_y"))
    left = ends(pairs).join(ends(judged.filter(F.col("backend") == backend)).select("_x", "_y"), ["_x", "_y"], "left_anti").drop("_x", "_y")
    return left if most is None else left.orderBy(F.desc("similarity"), "term_a", "term_b").limit(most)


def fitted(rows: DataFrame, context: str, rest: str, budget: int = 56 * 1024, step: int = 100) -> DataFrame:
    """rows with the context cut from its end, by so many characters at a time, until it and the rest fit a budget of UTF-8 bytes.

    The bytes of each stretch are counted once, from the end; the number of stretches that go is the first that suffices.
    An empty context goes with a rest that is too long by itself.
    """
    n, size = F.length(context), F.octet_length
    ends = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int")), lambda i: F.greatest(F.lit(0), n - i * step))
    start = F.struct((size(context) + size(rest)).cast("long").alias("bytes"), n.alias("keep"))

    def cut(acc: Column, end: Column) -> Column:
        gone = size(F.substring(context, end + 1, acc["keep"] - end))
        return F.when(acc["bytes"] <= budget, acc).otherwise(F.struct((acc["bytes"] - gone).alias("bytes"), end.alias("keep")))

    left = F.aggregate(ends, start, cut)["keep"]
    return rows.withColumn(context, F.substring(context, F.lit(1), left))


def covered(edges: DataFrame) -> DataFrame:
    """(item, files): the files that an item's subgraph touches, of (item, path), in order."""
    return edges.distinct().groupBy("item").agg(F.array_sort(F.collect_list("path")).alias("files"))


def riskiest(candidates: DataFrame, least_refs: int = 2, most: int = 15) -> DataFrame:
    """The candidates (item, refs, ...) with the most references, at least so many: a report of a fixed length."""
    return candidates.filter(F.col("refs") >= least_refs).orderBy(F.desc("refs"), "item").limit(most)
