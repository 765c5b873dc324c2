"""Connected components, and other steps several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.session import cut


#: Edges per written file.
EDGES = 250_000


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand at a time unless the session asks for another number.

    Spark's own ten thousand rows of some kilobytes are copied several times on their way, on heap,
    off heap and in Python, for every task at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id that ``edges`` (two id columns) names; the component is its smallest id.

    Alternating large and small stars: each round joins every vertex's neighbours to the smallest
    vertex it sees, first upwards, then downwards. The number of edges never grows, a hub's
    neighbours are reduced by partial aggregates, and the joins can be split by AQE. Each round is
    a table in the shared folder, so a lost executor costs one round at most. Only a count and a
    checksum of the edges reach the driver.
    """
    a, b = (F.col(c) for c in edges.columns)
    stars = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        count, total = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if (count, total) == mark or not count:
            break
        mark = (count, total)
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Few edges need few files: every file costs executors a process to set its mode.
        stars = cut(small.union(low).distinct().coalesce(-(-count // EDGES)), "edges")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
