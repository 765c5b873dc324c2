"""Repeated passages, by a compacted De Bruijn graph of words.

Edges are the windows of ``WINDOW`` consecutive words, and a text is a walk over them. Windows that
follow each other and have the same minimizer, the smallest hash among their runs of ``MARK``
words, form a path without a branch in between; a path is one row (minimizer, hash of all its words,
document, place, number of windows), about a seventh as many rows as windows. Windows with equal
words have equal minimizers, so only paths whose minimizer occurs twice can hold a repeat.

Spark joins compact the graph further. Paths with equal words are one class with a first occurrence;
all windows of later occurrences are repeats. Where a minimizer has a single class nothing branches
and nothing is left to do. Only where it has several are the windows of each class's first
occurrence looked at singly, to find those whose words start earlier in another class.

Source coordinates carry and verify the result: a path or window is compared by a BLAKE2b digest of
128 bits that is made, at each of its coordinates, from the words that stand there, never by a sum of
word hashes, so what is removed has the same words as what stays. Hashes of words only choose minimizers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common, words
from lakewarden.session import cut

WINDOW, MARK = 20, 8


def _paths_of(block: words.Words, window: int, mark: int) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, minimizer)`` of the paths of the texts in ``block``; ``start`` counts words of the text."""
    fits = np.flatnonzero(block.within(window)) if len(block.hash) >= window else np.zeros(0, np.int64)
    if not len(fits):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    marks = block.grams(mark, 300 + mark)
    wide = window - mark + 1
    # The first smallest mark of each window.
    best = marks[: len(marks) - wide + 1].copy()
    at = np.zeros(len(best), np.int64)
    for j in range(1, wide):
        less = marks[j : j + len(best)] < best
        best[less] = marks[j : j + len(best)][less]
        at[less] = j
    best, at = best[fits], at[fits] + fits
    opens = np.append(True, (at[1:] != at[:-1]) | (fits[1:] != fits[:-1] + 1) | (block.doc[fits[1:]] != block.doc[fits[:-1]]))
    heads = np.flatnonzero(opens)
    counts = np.diff(np.append(heads, len(fits)))
    first = fits[heads]
    text = block.doc[first]
    return text, first - block.first[text], counts, best[heads]


def _mark_rows(window: int, mark: int):
    """The minimizer of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in words.blocks(batch.column(2), fold=False):
                yield pa.RecordBatch.from_arrays([pa.array(_paths_of(block, window, mark)[3].view(np.int64))], names=["mark"])

    return run, "mark long"


def _path_rows(window: int, mark: int):
    schema = "mark long, path binary, id long, version long, at int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for low, high, block in words.blocks(batch.column(2), fold=False):
                text, at, n, mark_hash = _paths_of(block, window, mark)
                path = block.digests(block.first[text] + at, n + window - 1)
                columns = [mark_hash.view(np.int64), path, ids[low:high][text], versions[low:high][text], at.astype(np.int32), n.astype(np.int32)]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["mark", "path", "id", "version", "at", "n"])

    return run, schema


def _window_rows(window: int, mark: int):
    schema = "mark long, hash binary, id long, version long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            wanted = (owner << 32) | np.asarray(lists.flatten(), np.int64)
            for low, high, block in words.blocks(batch.column(2), fold=False):
                text, at, n, marks = _paths_of(block, window, mark)
                held = np.isin(((text + low) << 32) | at, wanted)
                text, at, n, marks = text[held], at[held], n[held], marks[held]
                steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places = np.repeat(at, n) + steps
                rows = np.repeat(text, n)
                digests = block.digests(block.first[rows] + places, np.full(len(rows), window))
                columns = [np.repeat(marks, n).view(np.int64), digests, ids[low + rows], versions[low + rows], places.astype(np.int32)]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["mark", "hash", "id", "version", "at"])

    return run, schema


def with_spans(
    docs: DataFrame, into: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mark: int = MARK, row_col: str | None = None
) -> DataFrame:
    """``docs`` with a new column ``into``: the covered words of each row as sorted ``struct<first, end>`` spans, null where there are none.

    Words are parted by white space and compared as they are. A window counts as repeated if its
    words also start earlier, in a document of smaller id or at an earlier word of the same one; all
    windows of the input are judged. Null, empty and short texts have no window. A row without an id
    is left alone. Rows with the same id and text are one document and get the same spans; rows with
    the same id and different texts are told apart by a hash of the text, and a window that starts
    at the same word of both is repeated in neither.

    With ``row_col``, a column of long numbers that no two rows share, every row is a document of its
    own: rows come in the order of id and number, those without an id last.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    if row_col is None:
        version, order, elsewhere = F.xxhash64(text), ["id", "at"], "id <> first.id or at <> first.at"
    else:
        ident, version = F.coalesce(ident, F.lit((1 << 63) - 1)), F.col(row_col)
        order, elsewhere = ["id", "version", "at"], "id <> first.id or version <> first.version or at <> first.at"
    texts = docs.select(ident.alias("id"), version.alias("version"), text.alias("text")).where("id is not null and text is not null")
    common.bounded_batches(docs.sparkSession)
    paths = texts.mapInArrow(*_path_rows(window, mark))
    # Written, so that both sides of the join are dealt anew and a very common mark can be split.
    again = cut(texts.mapInArrow(*_mark_rows(window, mark)).groupBy("mark").agg(F.count("*").alias("many")).where("many > 1").select("mark"), "marks")
    found = cut(paths.join(again, "mark", "left_semi"), "paths")
    place = F.struct(*order, *(c for c in ["version"] if c not in order))
    classes = cut(found.groupBy("mark", "path", "n").agg(F.min(place).alias("first"), F.count("*").alias("many")), "classes")
    later = (
        found.join(classes.where("many > 1").select("mark", "path", "n", "first"), ["mark", "path", "n"])
        .where(elsewhere)
        .select("id", "version", F.col("at").alias("first"), (F.col("at") + F.col("n") + window - 1).alias("end"))
    )
    forks = cut(classes.groupBy("mark").agg(F.count("*").alias("paths")).where("paths > 1").select("mark"), "forks")
    heads = classes.join(forks, "mark", "left_semi").select("first.id", "first.version", F.col("first.at").alias("at"))
    expand, windows_schema = _window_rows(window, mark)
    # Texts are dealt by id at every size; both joins below read the same exchange where plans allow.
    singles = texts.hint("merge").join(heads.groupBy("id", "version").agg(F.collect_list("at").alias("wanted")), ["id", "version"]).select("id", "version", "text", "wanted")
    windows = cut(singles.mapInArrow(expand, windows_schema), "windows")
    firsts = cut(windows.groupBy("mark", "hash").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("many")).where("many > 1"), "firsts")
    single = (
        windows.join(firsts.select("mark", "hash", "first"), ["mark", "hash"])
        .where(elsewhere)
        .select("id", "version", F.col("at").alias("first"), (F.col("at") + window).alias("end"))
    )
    # A document's spans are bounded by its own length.
    spans = later.union(single).groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias(into))
    own = common.unused("span_id", docs.columns), common.unused("span_version", docs.columns)
    spans = spans.withColumnsRenamed(dict(zip(("id", "version"), own, strict=True)))
    return docs.hint("merge").join(spans, (ident == F.col(own[0])) & (version == F.col(own[1])), "left").drop(*own)


def _rest(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """``(words, words outside the spans)`` of each text; a null counts as empty."""
    texts, spans = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (texts, spans))
    ends = np.cumsum(np.append(0, np.asarray(spans.value_lengths().fill_null(0))))
    flat = spans.flatten()
    first, last = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
    for k, text in enumerate(texts.cast(pa.binary())):
        # Splitting bytes parts at blanks and the control characters 9 to 13, and at nothing else.
        said = (text.as_py() or b"").split()
        low, high = ends[k], ends[k + 1]
        if low == high:
            yield len(said), said
            continue
        change = np.bincount(first[low:high], minlength=len(said) + 1) - np.bincount(last[low:high], minlength=len(said) + 1)
        kept = np.flatnonzero(np.cumsum(change)[: len(said)] == 0)
        yield len(said), [said[i] for i in kept.tolist()]


def kept_text(text_col: str, spans_col: str) -> Column:
    """The words outside the spans, joined by one blank; a null text becomes empty."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([b" ".join(kept).decode() for _, kept in _rest(texts, spans)], pa.string())

    # Else a filter on the result would run it a second time, in a second worker beside the first.
    return run.asNondeterministic()(F.col(text_col), F.col(spans_col))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row for each row of ``docs``; see ``with_spans`` for what is removed."""

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        total, removed, sha = [], [], []
        for n, kept in _rest(texts, spans):
            total.append(n)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["n_words", "n_removed", "kept_sha256"]
        )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(own, "spans", "doc_id", "text", window, mark)
    return found.select("doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.n_words", "d.n_removed", "d.kept_sha256")
