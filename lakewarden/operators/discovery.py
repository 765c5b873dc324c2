"""Discovery: list tables, register them, label them by name and by scanning samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import taxonomy
from lakewarden.operators import catalog, scan
from lakewarden.session import cut
from lakewarden.sources import tables as T

def selected(
    assets: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), max_assets: int | None = None
) -> tuple[DataFrame, Column]:
    """Assets under the globs, in listing order, cut at ``max_assets`` if given; and the cut as a test.

    Asset listings are metadata: one row per table.
    """
    fits = assets.where(catalog.wanted(F.col("urn"), include, exclude))
    if max_assets is None:
        return fits, F.lit(False)
    return fits.orderBy("urn").limit(max_assets), F.lit(fits.count() > max_assets)


def sample_leaves(tables: Mapping[str, DataFrame], scheme: str, limit: int | None) -> tuple[DataFrame | None, list[tuple]]:
    """String leaves of a sample of every table as one table, and what each sample covered.

    Each sample is written by a job of its own, so a table that cannot be read, wherever it breaks,
    becomes an error row and does not stop the others. One row more than ``limit`` is taken, to tell
    whether the sample is partial.
    """
    parts: list[DataFrame] = []
    outcomes: list[tuple] = []
    for name, df in sorted(tables.items()):
        urn = f"{scheme}.{name}"
        try:
            rows = T.sample(df, None if limit is None else limit + 1)
            numbered = cut(rows.select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("_n")), "sample")
            taken = numbered.count()
        except Exception as wrong:  # one unreadable table must not end the run
            outcomes.append((urn, 0, False, f"registered, but sampling failed: {str(wrong)[:200]}"))
            continue
        partial = limit is not None and taken > limit
        leaves = scan.leaf_table(numbered.limit(limit) if partial else numbered, "row", ["_n"]).select(
            F.lit(urn).alias("urn"), F.concat(F.lit("/"), F.col("_n").cast("string"), F.col("path")).alias("path"), "hint", "value", "too_deep"
        )
        parts.append(leaves)
        outcomes.append((urn, min(taken, limit) if partial else taken, partial, None))
    union = None
    for part in parts:
        union = part if union is None else union.unionByName(part)
    return union, outcomes


def run(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    scheme: str,
    known_assets: DataFrame,
    scan_rows: bool = True,
    limit: int | None = 100,
    min_confidence: float = 0.5,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_assets: int | None = None,
) -> dict[str, Any]:
    """One discovery run: ``outcomes`` and ``labels`` DataFrames, and ``truncated``.

    All samples are scanned in one job. Exclusion also means a table is never read.
    """
    assets, columns = T.discover(spark, dict(tables), scheme)
    chosen, cut = selected(assets, include, exclude, max_assets)
    names = {r.urn for r in chosen.select("urn").collect()}
    kept = {n: df for n, df in tables.items() if f"{scheme}.{n}" in names}
    suggested = T.suggested_labels(columns).where(F.col("label").isin(*taxonomy.SEVERITY_OF))
    imported = suggested.join(chosen, "urn", "left_semi").select(
        "urn", "label", F.lit("imported").alias("source"), F.lit(1.0).alias("confidence")
    )
    covered: list[tuple] = []
    found = None
    if scan_rows:
        leaves, covered = sample_leaves(kept, scheme, limit)
        if leaves is not None:
            found = catalog.scan_labels(scan.scan_leaves(leaves, ["urn"]), min_confidence)
    shape = "urn string, records_sampled bigint, partial_sample boolean, error string"
    reached = spark.createDataFrame(covered, shape)
    labels = imported if found is None else imported.unionByName(found, allowMissingColumns=True)
    per_asset = labels.groupBy("urn").agg(
        F.array_sort(F.collect_set(F.when(F.col("source") == "imported", F.col("label")))).alias("labels_imported"),
        F.array_sort(F.collect_set(F.when(F.col("source") == "scan", F.col("label")))).alias("labels_scanned"),
    )
    none = F.array().cast("array<string>")
    outcomes = (
        chosen.join(known_assets.select("urn", F.lit(True).alias("_known")), "urn", "left")
        .join(per_asset, "urn", "left")
        .join(reached, "urn", "left")
        .select(
            "urn",
            "name",
            "kind",
            F.col("_known").isNull().alias("created"),
            F.coalesce("labels_imported", none).alias("labels_imported"),
            F.coalesce("labels_scanned", none).alias("labels_scanned"),
            F.col("records_sampled").isNotNull().alias("sampled"),
            F.coalesce("records_sampled", F.lit(0)).alias("records_sampled"),
            F.coalesce("partial_sample", F.lit(False)).alias("partial_sample"),
            "error",
        )
    )
    return {"outcomes": outcomes, "labels": labels, "assets": chosen, "truncated": cut}


def report(outcomes: DataFrame) -> DataFrame:
    """One row about a run: created, updated, failed, classified, regulations."""
    both = F.array_union("labels_imported", "labels_scanned")
    rows = outcomes.withColumn("labels", both).withColumn("ok", F.col("error").isNull())
    totals = rows.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("created") & F.col("ok")).alias("created"),
        F.count_if(~F.col("created") & F.col("ok")).alias("updated"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.size("labels") > 0).alias("classified"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
    )
    return totals.withColumn("regulations", taxonomy.regulations(F.col("labels")))


def label_counts(outcomes: DataFrame) -> DataFrame:
    """Assets per label over a run."""
    each = outcomes.select(F.explode(F.array_union("labels_imported", "labels_scanned")).alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("assets"))


def audit_payload(outcomes: DataFrame, urns: int = 25) -> DataFrame:
    """The one audit row of a run: totals and the first labelled names, ``urns`` of them."""
    named = F.when(F.size(F.array_union("labels_imported", "labels_scanned")) > 0, F.col("urn"))
    return outcomes.agg(
        F.slice(F.array_sort(F.collect_list(named)), 1, urns).alias("classified_urns"),
        F.greatest(F.count(named) - urns, F.lit(0)).alias("classified_urns_omitted"),
    )
