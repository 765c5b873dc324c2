"""Running a stream over the files present now, into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewarden.session import cut, fresh_path

_ARROW = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(),
    "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string()),
}


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def into_table(stream: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Run an append stream to the end of its input; its sink table as a DataFrame."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, purpose), fresh_path(spark, f"{purpose}-state")
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, purpose: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a batch job on every micro-batch. A batch replayed after a failure replaces itself."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, purpose), fresh_path(spark, f"{purpose}-state")

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


#: What is kept between micro-batches, by name.
Kept = dict[str, DataFrame]


def each_batch_keeping(
    stream: DataFrame, purpose: str, schema: str, job: Callable[[DataFrame, Kept], tuple[DataFrame, Kept]]
) -> tuple[DataFrame, Kept]:
    """Run a batch job on every micro-batch, with the tables that the last one kept; all it made, and what is kept at the end.

    What a batch keeps is written under its number, so a batch replayed after a failure finds what it
    found before and replaces itself.
    """
    spark = stream.sparkSession
    out, kept, state = fresh_path(spark, purpose), fresh_path(spark, f"{purpose}-kept"), fresh_path(spark, f"{purpose}-state")
    names: dict[int, list[str]] = {}

    def kept_by(session: SparkSession, number: int) -> Kept:
        return {n: session.read.parquet(f"{kept}/{n}/batch={number}") for n in names.get(number, [])}

    def write(batch: DataFrame, number: int) -> None:
        made, keep = job(batch, kept_by(batch.sparkSession, number - 1))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")
        for name, table in keep.items():
            table.write.mode("overwrite").parquet(f"{kept}/{name}/batch={number}")
        names[number] = list(keep)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not names:
        return spark.createDataFrame([], schema), {}
    return spark.read.schema(f"{schema}, batch int").parquet(out).drop("batch"), kept_by(spark, max(names))


def folded(
    rows: DataFrame, before: DataFrame | None, key: str, order: list[Column], begin: Callable[[str | None], Any], schema: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of each key in their order through a fold: what it made, and the state of the keys it left open.

    ``begin`` makes a fold of the state kept, or of None; its ``take`` turns a row into tuples of
    ``schema``, which names the key; its ``left`` is the state to keep as text, or None. Rows pass
    through a task as a sorted flow of many keys, so a key costs no call of its own and no group
    stands in memory.
    """
    fields = [c.split(" ", 1) for c in f"{schema}, _state string".split(", ")]
    names = [n for n, _ in fields[:-1]]
    arrow = pa.schema([(n, _ARROW[t]) for n, t in fields])
    marked = rows.withColumn("_state", F.lit(None).cast("string"))
    if before is not None:
        marked = marked.unionByName(before, allowMissingColumns=True)
    ordered = marked.repartition(key).sortWithinPartitions(key, F.col("_state").isNull(), *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, one = None, None

        def ended() -> list[dict[str, Any]]:
            left = one.left() if one is not None else None
            return [] if left is None else [{key: open_key, "_state": left}]

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if one is None or row[key] != open_key:
                    made += ended()
                    open_key, one = row[key], begin(row["_state"])
                if row["_state"] is None:
                    made += [dict(zip(names, t, strict=True)) for t in one.take(SimpleNamespace(**row))]
            yield pa.RecordBatch.from_pylist(made, arrow)
        yield pa.RecordBatch.from_pylist(ended(), arrow)

    both = cut(ordered.mapInArrow(fold, ", ".join(f"{n} {t}" for n, t in fields)), "folded")
    return both.where(F.col("_state").isNull()).drop("_state"), both.where(F.col("_state").isNotNull()).select(key, "_state")
