"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job here is written for. Sizes follow the cluster, not the code.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Call-site capture costs several round trips per Column; the plans here have thousands.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Key material reaches plans as 64-byte literals; keep it out of explain() and event logs.
    "spark.sql.redaction.string.regex": r"(?i)x'[0-9a-f]{64,}'|\[[-0-9, ]{120,}\]",
}


def build_session(app: str = "lakewarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process (tests) gets a folder of its own; a
    cluster is refused, since its executors would each write to a disk the others cannot see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    made = tempfile.mkdtemp(prefix="lakewarden-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, never reused location under the shared folder."""
    return os.path.join(shared_folder(spark).rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def cut(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back, so later stages never recompute it.

    A written table survives the loss of any executor, unlike a cached block. It is read once or
    twice and never kept for long, so it is packed tighter than Spark's default.
    """
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _is_spread(plan) -> bool:
    """Whether a plan's rows were shuffled for this already; a union's, if those of all its parts were."""
    while plan.nodeName() in ("Project", "Filter", "Generate"):
        plan = plan.children().apply(0)
    if plan.nodeName() == "Union":
        return all(_is_spread(plan.children().apply(i)) for i in range(plan.children().size()))
    return plan.nodeName().startswith("Repartition")


#: Bytes of files per partition of a shuffled table; packed rows grow many times when they are moved.
SHARE = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work the same number of partitions on every core, and none that grows with the table.

    Judged by what the plan reads, without running any of it or listing its files: enough bytes to
    be split already keep every core busy and pass through untouched. A smaller table is shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if _is_spread(plan):
        return df
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    leaves = plan.collectLeaves()
    largest = max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)
    return df if largest >= cores * split else df.repartition(cores * max(1, -(-largest // (cores * SHARE))))
