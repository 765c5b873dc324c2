"""Byte-level BPE with tiktoken over a rank file.

The rank file is read where the work is done, once per Python worker, from a path that is a
parameter. A text longer than ``PART`` characters is cut first, only at a blank with a non-blank on
both sides: no match of the split pattern ends later than the character before such a blank or
begins earlier than the blank, so the parts' tokens are those of the whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
PART = 1 << 16
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; ``ranks`` is its path."""
    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in runs of about ``size`` characters that tokenize independently; a run without a safe blank stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(coder: tiktoken.Encoding, text: str, size: int = PART) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    return [i for part in parts(text, size) for i in coder.encode_ordinary(part)]


def _path(ranks: str | None) -> str:
    return ranks or public_tokenizers.path(RANKS)


def encode(text: Column, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text column; a null counts as empty and gives no ids."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        coder = encoding(_path(ranks), pattern)
        return pa.array([encode_text(coder, t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The raw bytes of a column of token ids; a null counts as no ids. They need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        coder = encoding(_path(ranks), pattern)
        return pa.array([coder.decode_bytes(x.as_py() or []) for x in lists], pa.binary())

    return run(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, its ids decoded, both digested.

    One row for each row of ``docs``; a null text is empty. The ids stay in the worker that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(_path(ranks), pattern)
        names = [str(i) for i in range(coder.max_token_value + 1)]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = encode_text(coder, text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
