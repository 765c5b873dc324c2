"""Near-duplicate vectors by a forest of random-projection trees.

Vectors with one label are compared by cosine, but only inside leaves. A node with more than
``LEAF`` vectors is split at the median of its vectors' projections on a random direction of its
own; vectors close to the median go to both sides, as far as two vectors of the lowest linked cosine
typically lie apart, so a linked pair is rarely parted, and hardly ever in all ``TREES`` trees. A
node whose vectors mostly lie within that distance cannot be parted that way; it stays whole,
however large, and its vectors are compared in blocks. A level so holds at most ``GROWTH`` times the ids
of the one before.

Splits are Spark jobs level by level: projections, a median per node by partial aggregates, a join.
Vectors are never copied into the levels, only ids. Exact copies are one member with a weight. A
pair that meets in several leaves counts in the smallest of them alone, so counts need no list of
pairs: a leaf yields a number per member, and edges that span its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common, vectors
from lakewarden.session import cut

TREES, LEAF, BLOCK = 4, 768, 768
#: Width of the shared band in standard deviations of a linked pair's distance along a direction.
SPILL = 1.5
#: A child with a larger share of its node's vectors means that the node cannot be parted, and so do
#: children that together hold a larger multiple of them: levels of such nodes would add up.
STUCK, GROWTH = 0.9, 1.5


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = np.asarray(batch.column(0))
        out = np.zeros(len(nodes))
        lengths = np.asarray(batch.column(2).value_lengths())
        for node in np.unique(nodes):
            held = np.flatnonzero(nodes == node)
            way = np.random.default_rng(int(node) & 0x7FFFFFFFFFFFFFFF).standard_normal(int(lengths[held[0]]))
            rows = vectors.unit(vectors.matrix(batch.column(2).take(pa.array(held))))
            out[held] = rows @ (way / np.sqrt(way @ way))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["node", "id", "p"])


def _leaf_links(cosine: float):
    schema = "id long, other long, links long"

    def run(table: pa.Table) -> pa.Table:
        leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        part = np.asarray(table.column("part"))
        ids, weight = np.asarray(table.column("id")), np.asarray(table.column("weight"))
        rows = vectors.unit(vectors.matrix(table.column("vector")))
        lists = table.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        held = np.asarray(lists.flatten())
        # Pairs that share a smaller leaf are counted there.
        smaller, at = np.unique(held[held < leaf], return_inverse=True)
        member = np.zeros((len(ids), len(smaller)), np.float32)
        member[owner[held < leaf], at] = 1
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near = rows[left] @ rows[right].T >= cosine
        if near.any():
            near &= member[left] @ member[right].T == 0
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(ids), np.int64)
        links[left] = near @ weight[right]
        if i != j:
            links[right] = near.T @ weight[left]
        a, b = np.nonzero(near)
        if i == j:
            a, b = a[a < b], b[a < b]
        a, b = vectors.spanning(ids[left[a]], ids[right[b]])
        counted = np.flatnonzero(links)
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[counted], a]), pa.int64()),
                "other": pa.array([*[None] * len(counted), *b.tolist()], pa.int64()),
                "links": pa.array(np.concatenate([links[counted], np.zeros(len(a), np.int64)]), pa.int64()),
            }
        )

    return run, schema


def forest(points: DataFrame, cosine: float, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``(leaf, id)``: the leaves of all trees over ``points`` (id, root, vector); one root never meets another."""
    by_id = points.select("id", "vector")
    spill = SPILL * float(np.sqrt(2 - 2 * cosine))
    done = []
    live = points.select("id", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "root").select(F.xxhash64("root", "tree").alias("node"), "id")
    while True:
        live = cut(live, "nodes")
        sizes = live.groupBy("node").agg(F.count("*").alias("many"))
        large = cut(sizes.where(F.col("many") > leaf), "large")
        if large.isEmpty():
            done.append(live)
            break
        done.append(live.join(large, "node", "left_anti"))
        thrown = cut(
            live.join(large.select("node"), "node", "left_semi").join(by_id, "id").select("node", "id", "vector").mapInArrow(_projected, "node long, id long, p double"),
            "projections",
        )
        middle = thrown.groupBy("node").agg(F.percentile_approx("p", 0.5, 2000).alias("mid"))
        widths = points.select(F.size("vector").alias("d")).agg(F.min("d").alias("d")).first()["d"]
        half = spill / 2 / float(np.sqrt(widths))
        sides = thrown.join(middle, "node").select(
            "node", "id", F.explode(F.expr(f"filter(array(if(p <= mid + {half}, 0, null), if(p >= mid - {half}, 1, null)), x -> x is not null)")).alias("side")
        )
        sides = cut(sides.select("node", F.xxhash64("node", "side").alias("child"), "id"), "sides")
        stuck = (
            sides.groupBy("node", "child")
            .agg(F.count("*").alias("held"))
            .groupBy("node")
            .agg(F.max("held").alias("held"), F.sum("held").alias("both"))
            .join(large, "node")
            .where((F.col("held") > STUCK * F.col("many")) | (F.col("both") > GROWTH * F.col("many")))
            .select("node")
        )
        done.append(thrown.select("node", "id").join(stuck, "node", "left_semi"))
        live = sides.join(stuck, "node", "left_anti").select(F.col("child").alias("node"), "id")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumnRenamed("node", "leaf").select("leaf", "id")


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``rows``.

    Rows are linked if their labels are equal and not null, their vectors have one length, and the
    cosine is at least ``cosine``, found in leaves and computed in double precision on the original
    components. ``n_links`` counts the other rows linked directly, copies included. Vectors that are
    null, empty, zero or hold null or non-finite components are linked with nothing. Rows with one
    id are one vertex; a row without an id has no component and is kept. Other columns are ignored.
    """
    vector = F.col(vector_col)
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label"))
    useful = cut(own.where(vectors.usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    classes = cut(useful.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "members")
    points = classes.select("id", F.xxhash64("label", F.size("vector")).alias("root"), "vector", "weight")
    leaves = cut(forest(points, cosine, trees, leaf).distinct(), "leaves")
    # A leaf with one member has nothing to compare.
    shared = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("many")).where("many > 1")
    lists = leaves.groupBy("id").agg(F.collect_set("leaf").alias("leaves"))
    placed = (
        leaves.join(shared.select("leaf", "parts"), "leaf")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("leaf", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id")
    )
    run, schema = _leaf_links(cosine)
    full = placed.join(lists, "id").join(points.select("id", "vector", "weight"), "id")
    found = cut(full.groupBy("leaf", "i", "j").applyInArrow(run, schema), "links")
    counts = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    members = useful.join(classes, ["label", "vector"]).select("vec_id", "id", "weight")
    groups = common.components(found.where("other is not null").select("id", "other").union(members.where("vec_id <> id").select("vec_id", "id")))
    linked = members.join(counts, "id", "left").groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return (
        own.select("vec_id")
        .join(linked, "vec_id", "left")
        .join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.expr("coalesce(component, vec_id) <=> vec_id").alias("kept"),
        )
    )
