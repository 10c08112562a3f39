"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

Each match of the split pattern is merged on its own by tiktoken. A long text is cut before a space or newline
that follows a word character: no match of the pattern can lie across such a place, so the parts give the ids of the
whole. Decoding joins the tokens' raw bytes, which need not be valid UTF-8 token by token.

Null and empty texts give no ids and no bytes. Repeated rows are encoded one by one. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a text that are given to the encoder at once, at least.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"\w(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank by line), without special tokens."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cuts a long text at safe places only; the parts joined are the text."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size - 1)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, special: bool = False) -> np.ndarray:
    """The ids of one text, as uint32; with special, the encoding's special tokens get their own ids."""

    def ids(x: str) -> np.ndarray:
        return np.array(enc.encode(x, allowed_special="all") if special else enc.encode_ordinary(x), dtype="<u4")

    return ids(text) if len(text) <= PART_CHARS else np.concatenate([ids(x) for x in parts(text)])


def decode_ids(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids."""
    return enc.decode_bytes(ids.tolist())


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit), a row for each row of docs; no shuffle."""

    def run(batches):
        enc = encoding(ranks_path)
        for batch in batches:
            for part, texts in slices(batch):
                ids = pa.array([encode_text(enc, x).tobytes() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    source = id_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary) to (doc_id, ids)."""

    def run(batches):
        enc = encoding(ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [decode_ids(enc, np.frombuffer(x, "<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"{encoded._jdf.schema().toDDL()}, decoded binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    path = public_tokenizers.path(RANKS)
    both = decode(encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
