"""Loading policies and catalog entries from documents."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import policy
from lakewarden.operators.catalog import infer_kind


def read_documents(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """A policy file: a JSON list, or an object with ``policies``. Policy sets are small."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    raw = json.loads(text)
    return list(raw["policies"] if isinstance(raw, Mapping) else raw)


def load_policies(spark: SparkSession, documents: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Policy documents as a stored table; duplicate keys are refused."""
    listed = list(documents)
    keys = [d["key"] for d in listed]
    repeated = sorted({k for k in keys if keys.count(k) > 1})
    if repeated:
        raise ValueError(f"duplicate policy keys: {', '.join(repeated)}")
    return policy.policy_table(spark, listed)


def load_catalog(spark: SparkSession, document: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(assets, labels, principals)`` from a catalog document."""
    assets, labels = [], []
    for a in document.get("assets") or []:
        assets.append((a["urn"], a.get("name"), a.get("kind"), a.get("owner"), a.get("description"), json.dumps(a.get("attributes") or {})))
        for c in a.get("classifications") or []:
            c = {"label": c} if isinstance(c, str) else c
            labels.append((a["urn"], c["label"], c.get("source", "manual"), float(c.get("confidence", 1.0))))
    people = [
        (p["external_id"], p.get("type", "unknown"), p.get("display_name", ""), json.dumps(p.get("attributes") or {}))
        for p in document.get("principals") or []
    ]
    asset_rows = spark.createDataFrame(assets, "urn string, name string, kind string, owner string, description string, a string")
    principal_rows = spark.createDataFrame(people, "external_id string, type string, display_name string, a string")
    return (
        asset_rows.select(
            "urn",
            F.coalesce("name", "urn").alias("name"),
            F.coalesce("kind", infer_kind(F.col("urn"))).alias("kind"),
            "owner",
            "description",
            attributes_from_json(F.col("a")).alias("attributes"),
        ),
        spark.createDataFrame(labels, "urn string, label string, source string, confidence double"),
        principal_rows.select(
            "external_id",
            "type",
            "display_name",
            attributes_from_json(F.col("a")).alias("attributes"),
            F.lit(None).cast("timestamp").alias("disabled_at"),
        ),
    )


def attributes_from_json(text):
    """A JSON object as the attribute map the catalog uses."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.coalesce(parsed, F.create_map().cast("map<string,variant>"))
