"""Documents drawn by how much their n-grams resemble a target's.

A text is lower-cased, its separators are collapsed to single blanks, and one overlapped regular
expression, whose borders are looked at and not consumed, matches at every word; its groups end
after one, two and three words, so each match gives the n-grams that begin there. They are never
built as strings of their own: the CRC of a longer one goes on from that of the shorter.

Counts by bucket stand in one written row per document. Their sums over the corpus and over the
target give each bucket a gain, a document's weight is the sum of its gains, and noise that depends
on the id alone turns the highest scores into a draw without replacement in proportion to weight.

Ranks take one exchange by ranges of the score: a row's rank is its place in its range and the
number of rows in the ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common
from lakewarden.session import cut

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: A-Z in small letters, all other ASCII but letters and digits as blanks.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
#: One to three words from each word on; the next match is looked for from the next character on.
_GRAMS = regex.compile(rb"(?<![^ ])([^ ]+)(?:( [^ ]+)( [^ ]+)?)?(?![^ ])")


def gram_codes(text: str) -> tuple[int, list[int]]:
    """``(words, CRC of each n-gram)`` of a text, n from one to three, repeats included."""
    collapsed = b" ".join(text.encode().translate(_FOLD).split())
    crc, words, codes = zlib.crc32, 0, []
    add = codes.append
    for match in _GRAMS.finditer(collapsed, overlapped=True):
        one, two, three = match.groups()
        words += 1
        code = crc(one)
        add(code)
        if two:
            code = crc(two, code)
            add(code)
            if three:
                add(crc(three, code))
    return words, codes


def features(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``(doc_id, n_words, n_features, bucket, many)``: the buckets of each text, sorted, and how many features fell into each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, total, ends, keys, many = [], [], [0], [], []
            for text in batch.column(1):
                words, codes = gram_codes(text.as_py() or "")
                found, times = np.unique(np.array(codes, np.int64) % buckets, return_counts=True)
                said.append(words)
                total.append(len(codes))
                ends.append(ends[-1] + len(found))
                keys.append(found.astype(np.int32))
                many.append(times.astype(np.int32))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (keys, many)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(said, pa.int64()), pa.array(total, pa.int64()), *lists], names=["doc_id", "n_words", "n_features", "bucket", "many"]
            )

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, bucket array<int>, many array<int>")


def _totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows; as many numbers as there are buckets reach the driver."""
    out = np.zeros(buckets, np.int64)
    summed = rows.selectExpr("inline(arrays_zip(bucket, many))").groupBy("bucket").agg(F.sum("many").alias("n"))
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share by bucket, each count one higher, rounded down."""
    buckets, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float((t + 1) * (all_s + buckets)) / float((s + 1) * (all_t + buckets)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            lists, many = batch.column(3), batch.column(4)
            value = by_bucket[np.asarray(lists.flatten(), np.int64)] * np.asarray(many.flatten(), np.int64)
            ends = np.cumsum(np.append(0, np.asarray(lists.value_lengths())))
            upto = np.append(0, np.cumsum(value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that depends on the seed and the id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def ranked(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """``rows``, written, with the place of each in ``order`` from 1, all tables and ties included.

    One exchange by ranges; how many rows each range has is all that reaches the driver.
    """
    part, place, start = (common.unused(x, [*rows.columns, into]) for x in ("range", "position", "start"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut(
        dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges"
    )
    many = sorted(written.groupBy(part).count().collect())
    before = np.cumsum([0, *(n for _, n in many)]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(many, before, strict=False)], f"{part} int, {start} long")
    # A row for each range.
    return written.join(F.broadcast(starts), part).withColumn(into, F.col(start) + F.col(place) + 1).drop(part, place, start)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row for each row of ``docs``.

    Of the rows with at least ``least_words`` words, the ``percent`` hundredths (rounded down) with
    the highest scores are drawn and ranked from 1, ties by smaller id, rows without an id after the
    others; ``rank`` is null for all else. Words are runs of ASCII letters and digits and of
    characters outside ASCII. A null, empty or blank text has no features and weight 0. Repeated rows
    are scored and drawn each on its own. Without rows, or without a target text, all still holds:
    every count is one higher than found. Other columns are ignored.
    """
    held = cut(features(docs, id_col, text_col, buckets), "features")
    wanted = target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text"))
    gain = gains(_totals(held, buckets), _totals(features(wanted, "id", "text", buckets), buckets))
    scored = _weighed(held, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fits = F.col("n_words") >= least_words
    order = [fits.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    drawn = percent * held.where(fits).count() // 100
    rank = F.when(fits & (F.col("place") <= drawn), F.col("place")).alias("rank")
    return ranked(scored, order, "place").select("doc_id", "n_features", "weight", "score", rank)
