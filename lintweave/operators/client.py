"""Calls to model services from executors, with answers that are kept.

A transport is a function from a list of texts to a list of answers of that length; it is injected and runs in the tasks.
What it raises decides what happens:

- ``Refused``: this request can't be answered as it is. A request of several texts is halved until the refused ones are alone;
  their refusal is kept as their answer.
- ``Stop``: no request will be answered (a wrong key, an unknown model). Nothing more is asked.
- anything else, and an answer of another length or form, may pass: the request is sent again after a pause. If no try
  succeeds, a malformed answer to several texts is halved as above; otherwise the service counts as gone, and nothing more is asked.

What was answered is kept in every case: texts that weren't asked stay open and are asked by the next run.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots

Transport = Callable[[list[str]], list]
Post = Callable[[dict], tuple[int, Any]]


class Refused(Exception):
    """The request is refused for what it holds."""


class Stop(Exception):
    """No request will be answered."""


class Malformed(ValueError):
    """An answer that isn't one for each text, or not of the form that is asked for."""


@dataclass(frozen=True)
class Policy:
    """tries for each request, seconds between them, and the most texts and characters of one request."""

    tries: int = 3
    pause: float = 2.0
    batch: int = 32
    chars: int = 1 << 20


def tried(transport: Transport, texts: list[str], policy: Policy = Policy()) -> list:
    """One request's answers; raises the last error when no try succeeds, Refused and Stop at once."""
    for k in range(policy.tries):
        try:
            out = transport(texts)
            if not isinstance(out, list) or len(out) != len(texts):
                raise Malformed(f"{len(texts)} texts need a list of as many answers")
            return out
        except (Refused, Stop):
            raise
        except Exception:
            if k + 1 == policy.tries:
                raise
            time.sleep(policy.pause)
    raise ValueError("a policy needs a try")


def requests_of(texts: list[str], policy: Policy) -> Iterator[tuple[int, int]]:
    """Bounds of requests in order: at most so many texts and characters each; a longer text is a request of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start == policy.batch or size + len(t) > policy.chars):
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def each(transport: Transport, texts: list[str], policy: Policy = Policy()) -> Iterator[tuple[Any, str | None, bool]]:
    """(answer, error, settled) of each text, in order; once the service is gone, of all that follow an error that isn't settled."""
    gone: str | None = None
    # requests that wait, the next one last
    waiting = list(requests_of(texts, policy))[::-1]
    while waiting:
        a, b = waiting.pop()
        if gone:
            yield from ((None, gone, False) for _ in range(a, b))
            continue
        try:
            yield from ((x, None, True) for x in tried(transport, texts[a:b], policy))
        except (Refused, Malformed) as x:
            if b - a > 1:
                middle = (a + b) // 2
                waiting += [(middle, b), (a, middle)]
            else:
                yield None, f"{type(x).__name__}: {x}", isinstance(x, Refused)
        except Exception as x:
            gone = f"{type(x).__name__}: {x}"
            waiting.append((a, b))


class Answers:
    """Kept answers of one model to texts, under a folder that all executors share; answer is their Spark type.

    They are keyed by SHA-256 of the text, so that equal texts are asked once, now and later, whatever rows hold them.
    """

    TABLE = "answers"

    def __init__(self, spark: SparkSession, root: str, answer: str):
        self.spark, self.kept = spark, Snapshots(spark, root)
        self.schema = f"key string, answer {answer}, error string, settled boolean"

    def all(self) -> DataFrame:
        """(key, answer, error, settled) of every time a text was taken up."""
        known = self.kept.manifest()
        return self.kept.read(self.TABLE) if self.TABLE in known else self.spark.createDataFrame([], self.schema)

    def known(self) -> DataFrame:
        """(key, answer, error) of settled texts, one row each, even if two runs asked at the same time."""
        return self.all().filter("settled").select("key", "answer", "error").dropDuplicates(["key"])

    def open(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(key, text): the different texts, nulls aside, that have no settled answer."""
        asked = rows.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        return asked.join(self.known().select("key"), "key", "left_anti")

    def ask(self, rows: DataFrame, transport: Transport, text: str = "text", policy: Policy = Policy(), rounds: int = 4) -> int:
        """Asks for all open texts and returns how many are still open: 0, unless the service failed.

        Texts go in rounds by their key; a round is committed as a whole, so a driver that dies loses the round under way
        only. A task that Spark repeats asks its texts again. After a round in which the service was gone no other begins.
        """

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gone = None
            for part in parts:
                if gone is None:
                    found = list(each(transport, list(part["text"]), policy))
                    # an error that passes means that the service is gone; a malformed answer to one text doesn't
                    gone = next((e for _, e, settled in found if not settled and not e.startswith(Malformed.__name__)), None)
                else:
                    found = [(None, gone, False)] * len(part)
                answers, errors, settled = zip(*found, strict=True) if found else ((), (), ())
                yield pd.DataFrame({"key": part["key"], "answer": pd.Series(answers, index=part.index, dtype=object), "error": pd.Series(errors, index=part.index, dtype=object), "settled": pd.Series(settled, index=part.index, dtype=bool)})

        for k in range(rounds):
            mine = self.open(rows, text).filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
            with self.kept.change() as change:
                change.add(self.TABLE, mine.mapInPandas(run, self.schema))
                version = change.tables[self.TABLE]
            last = self.spark.read.schema(self.schema).parquet(f"{self.kept.root}/{version['folders'][-1]}")
            if last.filter(~F.col("settled") & ~F.startswith("error", F.lit(Malformed.__name__))).limit(1).count():
                break
        return self.open(rows, text).count()

    def answered(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with answer and error; both null where the text is null or still open."""
        known = self.known().withColumnRenamed("key", "_key")
        return rows.withColumn("_key", F.sha2(text, 256)).join(known, "_key", "left").drop("_key")


def _status(status: int, body: Any) -> None:
    """Raises what a status means: 401 and 403 stop, other 4xx but 429 refuse, everything else but 200 may pass."""
    if status in (401, 403):
        raise Stop(f"status {status}")
    if 400 <= status < 500 and status != 429:
        raise Refused(f"status {status}")
    if status != 200:
        raise ConnectionError(f"status {status}")
    if not isinstance(body, dict):
        raise Malformed("not an object")


def vectors(post: Post, model: str, dims: int) -> Transport:
    """Embeddings of a service that takes {model, input} and gives {embeddings}: lists of so many numbers each."""

    def run(texts: list[str]) -> list:
        status, body = post({"model": model, "input": texts})
        _status(status, body)
        found = body.get("embeddings")
        if not isinstance(found, list) or len(found) != len(texts) or any(not isinstance(v, list) or len(v) != dims for v in found):
            raise Malformed(f"not a vector of {dims} numbers for each text")
        return [[float(x) for x in v] for v in found]

    return run


def decisions(post: Post, model: str, questions: dict) -> Transport:
    """Decisions of a service that takes {model, state, questions} and gives {answers: {...}}: JSON of the answers, a request for each text."""

    def run(texts: list[str]) -> list:
        out = []
        for t in texts:
            status, body = post({"model": model, "state": t, "questions": questions})
            _status(status, body)
            if not isinstance(body.get("answers"), dict):
                raise Malformed("no answers object")
            out.append(json.dumps(body["answers"], sort_keys=True))
        return out

    return run


def http(url: str, headers: dict[str, str] | None = None, timeout: float = 60) -> Post:
    """Posts JSON; the status and the parsed answer, of errors too."""

    def post(payload: dict) -> tuple[int, Any]:
        asked = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as got:
                return got.status, json.loads(got.read())
        except urllib.error.HTTPError as x:
            return x.code, None

    return post


def embedded(sections: DataFrame, stored: DataFrame, answers: Answers, transport: Transport, key: str = "section_id", policy: Policy = Policy()) -> DataFrame:
    """The next stored embeddings (key, digest, vector) of sections (key, text): those that lack one or whose text has changed are asked for.

    Sections that are gone go; those that the service refused or didn't answer have no row, so they are asked again if their text changes
    or, if they are open, by the next run.
    """
    now = sections.select(key, "text", F.sha2("text", 256).alias("digest"))
    known = stored.select(key, F.col("digest").alias("_digest"), F.col("vector").alias("_vector"))
    both = now.join(known, key, "left")
    fresh = F.col("digest").eqNullSafe(F.col("_digest"))
    todo = both.filter(~fresh)
    answers.ask(todo, transport, policy=policy)
    made = answers.answered(todo.select(key, "text", "digest")).filter("answer IS NOT NULL").select(key, "digest", F.col("answer").alias("vector"))
    return both.filter(fresh & F.col("_vector").isNotNull()).select(key, "digest", F.col("_vector").alias("vector")).unionByName(made)
