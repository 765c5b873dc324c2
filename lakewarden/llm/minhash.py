"""Near-duplicate texts by fast similarity sketches.

Every text becomes the set of its word shingles. A sketch has ``BANDS * ROWS`` coordinates. In
round ``i`` each element of the set is thrown into a hashed bin with the value ``i + hash``; a bin
keeps its smallest value, and rounds go on until no bin is empty. After as many rounds as there are
bins, round ``bins + j`` throws every element into bin ``j``, so the sketch of any non-empty set is
full after ``2 * bins`` rounds at the latest, while a set much larger than the sketch needs one or
two. Equal coordinates estimate the share of common elements with the concentration of sampling
without replacement.

Sketches are cut into bands. Texts that agree on a band are candidates, and a candidate pair counts
only after the two full sets were compared. A pair at the lowest linked similarity of 0.8 shares
none of the 24 bands of 4 rows with a chance of about 3 in a million.

Texts with equal sets are one class from the start. Whoever shares a band's bucket shares that
bucket's first class, its pivot; the classes of a pivot's group are compared in blocks of bounded
size by matrix products over their hashed shingles. Of the pairs found, those that join two
components are compared once more, as words, before they count as links.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common, words
from lakewarden.session import cut

BANDS, ROWS = 24, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingle_sets(block: words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(elements, sizes)``: the distinct shingle hashes of each text, sorted, one text after the other."""
    whole, starts = block.grams(n, n), block.first
    inner = np.maximum(block.count - n + 1, 0)
    keys = words.seeds(n, 1000 + n)
    sets = []
    for first, many, have in zip(starts, inner, block.count, strict=True):
        if many:
            one = np.sort(whole[first : first + many])
            sets.append(one[np.append(True, one[1:] != one[:-1])])
        elif have:
            # Fewer words than a shingle has: the whole text is its only element.
            sets.append(words.mix((block.hash[first : first + have] * keys[:have]).sum(keepdims=True) + np.uint64(have)))
        else:
            sets.append(whole[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else whole[:0], sizes


def sketch(elements: np.ndarray, sizes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``bins`` values per set; an empty set leaves its row at the largest value."""
    out = np.full((len(sizes), bins), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    salts = words.seeds(2 * bins, 77)
    for turn in range(2 * bins):
        if not len(elements):
            break
        hashed = words.mix(elements ^ salts[turn])
        at = ((hashed >> _HALF) * np.uint64(bins) >> _HALF).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, owner * bins + at, (np.uint64(turn) << _HALF) | (hashed & _LOW))
        open_sets = (out == _EMPTY).any(axis=1)[owner]
        elements, owner = elements[open_sets], owner[open_sets]
    return out


def bands(sketches: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per band; the band's number is part of the hash, so equal hashes mean the same band."""
    parts = sketches.reshape(len(sketches), n_bands, rows) * words.seeds(rows, 5)[None, None, :]
    return words.mix(parts.sum(axis=2, dtype=np.uint64) ^ words.seeds(n_bands, 6)[None, :])


def _sketched(n: int):
    schema = "id long, n_shingles long, print_a long, print_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in words.blocks(batch.column(1), fold=True):
                elements, sizes = shingle_sets(block, n)
                ends = np.cumsum(sizes)
                full = sizes > 0
                prints = np.zeros((2, len(sizes)), np.uint64)
                if full.any():
                    heads = (ends - sizes)[full]
                    prints[0, full] = np.add.reduceat(words.mix(elements), heads)
                    prints[1, full] = np.add.reduceat(words.mix(elements ^ words.seeds(1, 9)[0]), heads)
                keys = bands(sketch(elements, sizes)).view(np.int64)
                counts = np.where(full, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(sizes),
                        *(pa.array(p.view(np.int64)) for p in prints),
                        pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), keys[full].reshape(-1)),
                    ],
                    names=["id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return run, schema


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of sets with ``100 * common >= percent * union``, by exact counts.

    ``right`` None pairs ``left`` with itself, each pair once. Sets are sorted distinct hashes. Only
    elements that two sets share become columns, ``columns`` of them at a time.
    """
    one = right is None
    sides = [left] if one else [left, right]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    flat = [np.concatenate(side) for side in sides]
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    if one:
        shared, times = np.unique(flat[0], return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(sides[-1])), np.float32 if max(s.max(initial=0) for s in sizes) < 1 << 24 else np.float64)
    if len(shared):
        marks = []
        for values, own in zip(flat, owner, strict=True):
            at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
            held = shared[at] == values
            order = np.argsort(at[held], kind="stable")
            marks.append((at[held][order], own[held][order]))
        for low in range(0, len(shared), columns):
            width = min(columns, len(shared) - low)
            tables = []
            for (at, own), size in zip(marks, sizes, strict=True):
                x, y = np.searchsorted(at, (low, low + width))
                table = np.zeros((len(size), width), common.dtype)
                table[own[x:y], at[x:y] - low] = 1
                tables.append(table)
            common += tables[0] @ tables[-1].T
    common = common.astype(np.int64)
    union = sizes[0][:, None] + sizes[-1][None, :] - common
    hit = (100 * common >= percent * union) & (common > 0)
    return np.nonzero(np.triu(hit, 1) if one else hit)


def _links(n: int, percent: int):
    schema = "a long, b long"

    def run(table: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for _, _, block in words.blocks(table.column("text"), fold=True):
            elements, sizes = shingle_sets(block, n)
            sets += np.split(elements, np.cumsum(sizes)[:-1])
        ids, part = np.asarray(table.column("member")), np.asarray(table.column("part"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(part == i)
        if i == j:
            x, y = similar_pairs([sets[k] for k in left], None, percent)
            left, right = left, left
        else:
            right = np.flatnonzero(part == j)
            if not len(left) or not len(right):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            x, y = similar_pairs([sets[k] for k in left], [sets[k] for k in right], percent)
        a, b = confirmed(left[x], right[y], table.column("text"), n, percent)
        a, b = ids[a], ids[b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run, schema


_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_words(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words."""
    # Splitting bytes parts at blanks and the control characters 9 to 13, and at nothing else.
    said = (text or "").encode().translate(_LOWER).split()
    return set(zip(*(said[i:] for i in range(n)), strict=False)) if len(said) >= n else {tuple(said)} if said else set()


def confirmed(x: np.ndarray, y: np.ndarray, texts: pa.ChunkedArray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs ``x -- y`` of rows that join two components and hold for the shingles as words."""

    @functools.lru_cache(maxsize=2)
    def shingles(k: int) -> set[tuple[bytes, ...]]:
        return shingle_words(texts[k].as_py(), n)

    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    kept: list[tuple[int, int]] = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        one, two = find(a), find(b)
        if one != two:
            common = len(shingles(a) & shingles(b))
            if common and 100 * common >= percent * (len(shingles(a)) + len(shingles(b)) - common):
                root[max(one, two)] = min(one, two)
                kept.append((a, b))
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


#: Members and shingles of the blocks that a group's sets are compared in.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Words are told apart by white space and compared with A-Z lower-cased; a text with fewer than
    ``n`` words is one shingle; a null, empty or blank text has none and is linked with nothing.
    Two texts are linked if ``100 * common >= percent * union`` holds for their shingle sets.
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the row that bears it.
    Rows with one id are one vertex, linked by whatever either text is linked with; a row without an
    id is nobody's duplicate, has a null component and is kept. Other columns of ``docs`` are ignored.
    """
    common.bounded_batches(docs.sparkSession)
    run, schema = _sketched(n)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = cut(texts.mapInArrow(run, schema), "sketches")
    prints = ["n_shingles", "print_a", "print_b"]
    classes = sketches.where("n_shingles > 0 and id is not null").groupBy(*prints).agg(F.min("id").alias("rep"))
    keyed = sketches.where("n_shingles > 0").join(classes.select(F.col("rep").alias("id"), *prints), ["id", *prints], "left_semi")
    keyed = keyed.select("id", "n_shingles", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("many")).where("many > 1")
    # Whoever shares a bucket shares that bucket's pivot, so comparing inside pivot groups covers every candidate pair.
    group = cut(keyed.join(pivots.drop("many"), "key").select("pivot", F.col("id").alias("member"), "n_shingles").distinct(), "groups")
    parts = group.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    dealt = group.join(parts, "pivot").select("pivot", "member", "parts", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "member"
    )
    compare, linked = _links(n, percent)
    # Texts and places are both sorted by id at every size, so that costs grow in proportion.
    links = texts.withColumnRenamed("id", "member").hint("merge").join(placed, "member").groupBy("pivot", "i", "j").applyInArrow(compare, linked)
    same = sketches.where("n_shingles > 0 and id is not null").join(classes, prints).where("id <> rep").select("id", "rep")
    found = common.components(links.union(same))
    return (
        sketches.select("id", "n_shingles")
        .join(found, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.expr("coalesce(component, id) <=> id").alias("kept"),
        )
    )
