"""The derived requests and catalog in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.catalog import ATTRIBUTES, as_variant
from lakewarden.plans import derived
from lakewarden.session import spread

KEY = b"check-key-audit"


def variant_map(**values: Column) -> Column:
    """A variant map of those values that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), as_variant(v).alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def access_requests(spark: SparkSession, sf: str) -> DataFrame:
    return as_requests(spread(derived.table(spark, sf, "requests")))


def as_requests(r: DataFrame) -> DataFrame:
    """Flat request rows in the shape that decisions read."""
    none = F.create_map().cast(ATTRIBUTES)
    labels = F.when(F.col("declared_label").isNotNull(), F.array("declared_label")).otherwise(
        F.array().cast("array<string>")
    )
    return r.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.struct(
            F.col("principal_id").alias("id"),
            F.col("principal_type").alias("type"),
            variant_map(trust_tier=F.col("claimed_tier")).alias("attributes"),
        ).alias("principal"),
        "action",
        F.struct(
            F.col("urn"),
            F.lit(None).cast("string").alias("kind"),
            labels.alias("classifications"),
            none.alias("attributes"),
        ).alias("resource"),
        variant_map(destination=F.col("destination"), purpose=F.col("purpose"), amount=F.col("value")).alias("context"),
        "payload",
    )


def catalog_principals(spark: SparkSession, sf: str) -> DataFrame:
    p = derived.table(spark, sf, "principals")
    return p.select(
        "external_id",
        "type",
        "display_name",
        variant_map(trust_tier=F.col("trust_tier"), team=F.col("team")).alias("attributes"),
        F.when(F.col("disabled"), F.to_timestamp(F.lit("2024-01-10 00:00:00"))).alias("disabled_at"),
    )


def catalog_assets(spark: SparkSession, sf: str) -> DataFrame:
    a = derived.table(spark, sf, "assets")
    return a.select(
        "urn",
        "name",
        "kind",
        "owner",
        "description",
        variant_map(
            region=F.col("zone"),
            tier=F.col("tier"),
            routing_priority=F.col("rank"),
            routing_enabled=F.when(F.col("kind") == "model", F.col("routable")),
            aliases=F.when(F.col("alias").isNotNull(), F.array("alias")),
        ).alias("attributes"),
    )


def asset_labels(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "asset_labels")
