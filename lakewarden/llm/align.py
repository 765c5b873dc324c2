"""Two tokenizers of the same texts, aligned by the byte offsets at which their tokens end.

Texts are shuffled by their whole text first, so that equal ones become one row with the number of
its copies. Each distinct text is tokenized by both and aligned once. What a pair of ids is linked
with is counted over the corpus, each text weighted by its copies, and the measures are joined to all
documents again by the text's SHA-256.

Pairs are many more than texts, so they never travel one by one. The texts that a task aligns
together form a block of bounded size; a block lists each pair once, its texts refer to that list, and
only the lists are summed, joined with the corpus-wide counts and brought back to their blocks. A very
common pair is one row of each block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import bpe, common
from lakewarden.session import cut

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of the texts of a block; a longer text is a block of its own.
BLOCK = 1 << 21
_COMMA, _BAR, _SEMI = range(3)


class Aligner:
    """Both tokenizers and, by id, the bytes their tokens stand for."""

    def __init__(self, ranks: str, pieces: str) -> None:
        self.a = bpe.encoding(ranks, public_tokenizers.PATTERN)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        known = {i: t for t, i in self.a._mergeable_ranks.items()}
        self.a_bytes = [known.get(i, b"") for i in range(self.a.max_token_value + 1)]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.piece_size()))
        ]
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.width)]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where the text is empty or one of them does not spell it out."""
        if not text:
            return None
        said = " " + text
        wanted = said.encode()
        a, b = bpe.encode_text(self.a, said), self.b.encode(text, num_threads=1)
        for ids, spelled in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(spelled.__getitem__, ids)) != wanted:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """``(a, b)`` places of the last token of each group, and the groups spelled out."""
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        # A token stands after all tokens of earlier groups, and one of b after those of a of its own group.
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        upto_a, upto_b = last_a + 1, np.append(0, last_b + 1)
        mark_a, mark_b = np.full(len(a), _COMMA), np.full(len(b), _COMMA)
        mark_a[last_a], mark_b[last_b] = _BAR, _SEMI
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + upto_b[group_a]] = mark_a * self.width + a
        codes[np.arange(len(b)) + upto_a[group_b]] = mark_b * self.width + b
        return last_a, last_b, "".join(map(self.names.__getitem__, codes.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def aligner(ranks: str, pieces: str) -> Aligner:
    return Aligner(ranks, pieces)


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """``(from, to)`` of runs of texts with about ``size`` bytes each."""
    low = held = 0
    for at, text in enumerate(texts):
        many = text.as_buffer().size
        if held and held + many > size:
            yield low, at
            low, held = at, 0
        held += many
    if len(texts) > low:
        yield low, len(texts)


_ALIGNED = "block long, digest string, n_a long, n_b long, n_groups long, groups_sha256 string, link array<int>, times array<int>, a array<int>, b array<int>, many array<long>"


def _aligned(ranks: str | None, pieces: str | None, size: int):
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(ranks or public_tokenizers.path(RANKS), pieces or public_tokenizers.path(PIECES))
        for batch in batches:
            number, digests, copies = batch.column(0), batch.column(1), np.asarray(batch.column(3))
            for low, high in _runs(batch.column(2), size):
                rows, keys, owners = [], [], []
                for k in range(low, high):
                    found = known.ids(batch.column(2)[k].as_py())
                    if found is None:
                        rows.append([digests[k].as_py(), 0, 0, 0, ""])
                        continue
                    a, b = found
                    last_a, last_b, said = known.groups(a, b)
                    rows.append([digests[k].as_py(), len(a), len(b), len(last_a), hashlib.sha256(said.encode()).hexdigest()])
                    keys.append((a[last_a] << 32) | b[last_b])
                    owners.append(np.full(len(last_a), k - low))
                # Each pair of the block once; a text's links refer to it by place.
                pairs, place = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
                owner = np.concatenate([*owners, np.zeros(0, np.int64)])
                links, times = np.unique((owner << 32) | place, return_counts=True)
                owner, link = links >> 32, (links & 0xFFFFFFFF).astype(np.int32)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, link, times * copies[low + owner])
                at = np.searchsorted(owner, np.arange(high - low + 1))
                lists = [([link[x:y], times[x:y].astype(np.int32)]) for x, y in zip(at[:-1], at[1:], strict=True)]
                first = [(pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), total]
                columns = [[number[low].as_py()] * len(rows), *zip(*rows, strict=True), *zip(*lists, strict=True)]
                columns += [[x, *[None] * (len(rows) - 1)] for x in first]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


_MEASURED = "digest string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _measure(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's texts with the sums over their links of what the corpus has for each pair."""
    count, best = (np.zeros(len(pairs), np.int64) for _ in range(2))
    place = np.asarray(pairs.column("place"))
    count[place], best[place] = np.asarray(pairs.column("count")), np.asarray(pairs.column("is_best"))
    lists = texts.column("link").combine_chunks()
    link, times = np.asarray(lists.flatten(), np.int64), np.asarray(texts.column("times").combine_chunks().flatten(), np.int64)
    ends = np.cumsum(np.append(0, np.asarray(lists.value_lengths())))

    def summed(values: np.ndarray) -> pa.Array:
        upto = np.append(0, np.cumsum(values))
        return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

    held = texts.select(["digest", "n_a", "n_b", "n_groups"])
    held = held.append_column("n_links", summed(times)).append_column("n_best", summed(best[link] * times)).append_column("count_sum", summed(count[link] * times))
    return held.append_column("groups_sha256", texts.column("groups_sha256"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pieces: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row for each row of ``docs``.

    A is the byte-level vocabulary ``ranks`` over a blank and the text, B the sentence pieces of
    ``pieces``, which put that blank themselves. Offsets at which tokens of both end cut them into
    groups; the tokens that end there are linked. ``n_best`` counts links whose pair is linked as
    often as any pair of its B id, ``count_sum`` adds up how often the pairs are linked in the corpus.
    Null and empty texts, and texts that A or B does not spell out, have zeros and an empty string.
    Repeated rows and rows without an id count as documents of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    text = F.col(text_col)
    distinct = (
        docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
        # The number of a block's first text names the block.
        .select(F.monotonically_increasing_id().alias("number"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text", "copies")
    )
    aligned = cut(distinct.mapInArrow(_aligned(ranks, pieces, block), _ALIGNED), "aligned")
    pairs = aligned.where("a is not null").selectExpr("block as owner", "posexplode(arrays_zip(a, b, many)) as (place, pair)").select("owner", "place", "pair.*")
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("many").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    scored = counts.join(highest, "b").select("a", "b", "count", F.expr("cast(count = highest as long)").alias("is_best"))
    back = pairs.select("owner", "place", "a", "b").join(scored, ["a", "b"]).select("owner", "place", "count", "is_best")
    texts = aligned.select("block", "digest", "n_a", "n_b", "n_groups", "groups_sha256", "link", "times")
    measured = texts.groupBy("block").cogroup(back.groupBy("owner")).applyInArrow(_measure, _MEASURED)
    # SHA-256 stands for the text here: no two texts are known to share one.
    own = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = own.join(measured, "digest", "left")
    return found.select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
