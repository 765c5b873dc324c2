"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewarden.plans import derived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Query, sql: str | None = None) -> None:
    """Register a query; ``sql`` names tables in braces and may use derived ones."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir.rstrip("/"))

    QUERIES[name] = in_utc
    if sql is not None:
        ORACLES[name] = derived.duck(sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        add(name, build, sql)
        return build

    return register
