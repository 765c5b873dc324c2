"""Nearest neighbours by inner product, through a permutation index.

``PIVOTS`` vectors, a bounded sample in the order of a hash of their ids, stand as landmarks. Every
vector is represented by its ``PREFIX`` nearest pivots in order: a row's by distance, which is the
order of ``row . pivot - |pivot|^2 / 2``, a query's by inner product. Nothing depends on the norms of
other rows, so a single huge vector moves no other row's pivots.

Vectors are dealt into blocks of about ``BLOCK`` rows, and each block posts its vectors in inverted
files, one list of (vector, rank) per pivot. A block of queries runs through the lists of its own
pivots. Two prefixes of length ``L`` have the footrule distance ``L(L+1) - 2 * sum(L - max(r, s))``
over the pivots they share at ranks ``r`` and ``s`` from 0, so lists only add up the shared part.
The ``SHARE`` of a block's vectors with the smallest distance is reranked by the exact product, and
each query keeps the best of all blocks. The share is a fixed part of all vectors at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm import vectors
from lakewarden.session import cut

PIVOTS, PREFIX, SHARE = 512, 64, 0.15
BLOCK, QUERY_BLOCK = 8192, 1024


def _indexed(pivots: dict[int, np.ndarray], prefix: int):
    schema = "id long, vector array<double>, dim int, asks boolean, nearest binary, asked binary"

    def ranked(closeness: np.ndarray) -> np.ndarray:
        many = min(prefix, closeness.shape[1])
        best = np.argpartition(-closeness, many - 1, axis=1)[:, :many]
        order = np.argsort(-np.take_along_axis(closeness, best, 1), axis=1, kind="stable")
        return np.take_along_axis(best, order, 1).astype("<i2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                held = batch.filter(pa.compute.equal(batch.column(2), dim))
                rows, marks = vectors.matrix(held.column(1)), pivots[dim]
                flat = rows @ marks.T
                nearest = ranked(flat - (marks * marks).sum(axis=1)[None, :] / 2)
                asked = ranked(flat)
                asks = held.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        held.column(0),
                        held.column(1),
                        held.column(2),
                        held.column(3),
                        pa.array([x.tobytes() for x in nearest], pa.binary()),
                        pa.array([x.tobytes() if q else None for x, q in zip(asked, asks, strict=True)], pa.binary()),
                    ],
                    names=["id", "vector", "dim", "asks", "nearest", "asked"],
                )

    return run, schema


def footrule_overlap(queries: np.ndarray, rows: np.ndarray, pivots: int, prefix: int) -> np.ndarray:
    """``sum(prefix - max(r, s))`` over shared pivots, for each query and row; larger is nearer."""
    out = np.zeros((len(queries), len(rows)), np.int32)
    files = []
    for table in (queries, rows):
        flat = table.reshape(-1)
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(pivots + 1))
        owner, weight = np.divmod(order, table.shape[1])
        files.append((owner, (prefix - weight).astype(np.int32), ends))
    (asks, ask_weight, ask_ends), (owner, weight, ends) = files
    for p in range(pivots):
        a, b, c, d = ask_ends[p], ask_ends[p + 1], ends[p], ends[p + 1]
        if a < b and c < d:
            posted, least = owner[c:d], weight[c:d]
            for q, w in zip(asks[a:b], ask_weight[a:b], strict=True):
                out[q, posted] += np.minimum(least, w)
    return out


def _searched(pivots: int, prefix: int, share: float, k: int):
    schema = "query_id long, vec_id long, score double"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = np.asarray(table.column("is_query"))
        wide = lambda c: np.frombuffer(b"".join(c.to_pylist()), "<i2").reshape(len(c), -1).astype(np.int64)
        told, data = table.filter(pa.array(asks)), table.filter(pa.array(~asks)).sort_by("id")
        if not len(told) or not len(data):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, ids = np.asarray(told.column("id")), np.asarray(data.column("id"))
        q_rows, rows = vectors.matrix(told.column("vector")), vectors.matrix(data.column("vector"))
        q_near, near = wide(told.column("nearest")), wide(data.column("nearest"))
        chosen = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
        out = []
        for at in range(0, len(q_ids), 128):
            overlap = footrule_overlap(q_near[at : at + 128], near, pivots, prefix).astype(np.int64)
            # Ties go to the smaller id: rows are in the order of their ids.
            order = overlap * len(ids) - np.arange(len(ids))[None, :]
            best = np.argpartition(-order, chosen - 1, axis=1)[:, :chosen]
            for query, row, held in zip(q_ids[at : at + 128], q_rows[at : at + 128], best, strict=True):
                held = np.sort(held[ids[held] != query])
                score = np.einsum("ij,j->i", rows[held], row)
                top = np.lexsort((ids[held], -score))[:k]
                out.append((np.full(len(top), query), ids[held][top], score[top]))
        return pa.table({n: pa.array(np.concatenate(c), t) for n, c, t in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run, schema


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` picks, its ``k`` nearest rows found, from rank 1.

    Candidates are all rows but those with the query's own id. Ties go to the smaller id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors
    of different lengths never meet. A repeated row is a candidate, and a query, once.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    useful = own.where(vectors.usable(F.col("vector")) & F.col("id").isNotNull()).select("id", "vector", F.size("vector").alias("dim"), "asks").distinct()
    useful = cut(useful, "vectors")
    dims = useful.groupBy("dim").agg(F.count("*").alias("many"), F.sum(F.col("asks").cast("int")).alias("asking")).collect()
    turn = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "vector")
    # A bounded sample of each length: the pivots.
    sample = useful.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= pivots).select("dim", "n", "vector").collect()
    marks = {d["dim"]: np.array([r["vector"] for r in sorted((r for r in sample if r["dim"] == d["dim"]), key=lambda r: r["n"])]) for d in dims}
    build, schema = _indexed(marks, prefix)
    index = cut(useful.mapInArrow(build, schema), "index")
    sizes = spark.createDataFrame(
        [(d["dim"], max(1, -(-d["many"] // block)), max(1, -(-(d["asking"] or 0) // query_block))) for d in dims], "dim int, blocks int, query_blocks int"
    )
    known = index.join(F.broadcast(sizes), "dim")  # a row per vector length
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = known.select("dim", part("blocks").alias("i"), other("query_blocks").alias("j"), F.lit(False).alias("is_query"), "id", "vector", "nearest")
    told = known.where("asks").select("dim", other("blocks").alias("i"), part("query_blocks").alias("j"), F.lit(True).alias("is_query"), "id", "vector", F.col("asked").alias("nearest"))
    run, found_schema = _searched(pivots, prefix, share, k)
    found = data.union(told).groupBy("dim", "i", "j").applyInArrow(run, found_schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
