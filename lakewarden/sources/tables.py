"""Listing tables as catalog assets and reading samples of them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import taxonomy

# Column names that suggest a label, in order of precedence.
NAME_HINTS: tuple[tuple[str, str], ...] = (
    ("ssn", "pii.ssn"),
    ("social_security", "pii.ssn"),
    ("email", "pii.email"),
    ("email_address", "pii.email"),
    ("phone", "pii.phone"),
    ("phone_number", "pii.phone"),
    ("date_of_birth", "pii.dob"),
    ("dob", "pii.dob"),
    ("birth_date", "pii.dob"),
    ("address", "pii.address"),
    ("street_address", "pii.address"),
    ("passport", "pii.passport"),
    ("passport_number", "pii.passport"),
    ("card_number", "pci.card_number"),
    ("credit_card", "pci.card_number"),
    ("pan", "pci.card_number"),
    ("iban", "pci.iban"),
    ("mrn", "phi.mrn"),
    ("medical_record_number", "phi.mrn"),
    ("npi", "phi.npi"),
    ("icd10", "phi.icd10"),
    ("diagnosis_code", "phi.icd10"),
    ("password", "secret.password"),
    ("api_key", "secret.generic_api_key"),
    ("access_token", "secret.generic_api_key"),
    ("ip_address", "pii.ip_address"),
)
COLUMNS = "urn string, position int, column string, type string, comment string"
ASSETS = "urn string, name string, kind string, description string, columns array<string>"


def is_vector(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType))


def folder_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every parquet table of a folder on any file system Spark can reach, by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in files if f.getPath().getName().endswith(".parquet"))
    return {n.removesuffix(".parquet"): spark.read.parquet(os.path.join(folder, n)) for n in names}


def catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """Every table and view of a database in the session catalog, by name."""
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)}


def discover(
    spark: SparkSession, tables: dict[str, DataFrame], scheme: str, kind: str = "table"
) -> tuple[DataFrame, DataFrame]:
    """``(assets, columns)`` of a set of tables, from their schemas alone."""
    assets, columns = [], []
    for name, df in sorted(tables.items()):
        urn = f"{scheme}.{name}"
        of_kind = "vector_collection" if any(is_vector(f.dataType) for f in df.schema) else kind
        assets.append((urn, name, of_kind, "", df.columns))
        for at, f in enumerate(df.schema):
            columns.append((urn, at, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")))
    return spark.createDataFrame(assets, ASSETS), spark.createDataFrame(columns, COLUMNS)


def row_counts(tables: dict[str, DataFrame], scheme: str) -> DataFrame:
    """Rows per table, as one job over the files' own metadata."""
    parts = [
        df.agg(F.count("*").alias("approx_rows")).select(F.lit(f"{scheme}.{name}").alias("urn"), "approx_rows")
        for name, df in sorted(tables.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vector_facts(df: DataFrame, urn: str) -> DataFrame:
    """Points and vector size of a table with embedding columns, one row per such column."""
    vectors = [f.name for f in df.schema if is_vector(f.dataType)]
    cells = [F.count("*").alias("points_count")] + [F.max(F.size(v)).alias(v) for v in vectors]
    wide = df.agg(*cells)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("n"), F.col(v).alias("s")) for v in vectors]))
    return wide.select(F.lit(urn).alias("urn"), "points_count", rows.alias("v")).select(
        "urn", "points_count", F.col("v.n").alias("vector_name"), F.col("v.s").alias("vector_size")
    )


# --------------------------------------------------------------------------- suggestions


def suggested_labels(columns: DataFrame) -> DataFrame:
    """``(urn, label)`` suggested by column names and comments, distinct.

    An exact name decides alone. Otherwise the first hint contained in the name counts, and
    so does every concrete label written in the comment. The hints are a 26-row constant.
    """
    name = F.lower("column")
    exact = F.create_map(*[F.lit(x) for pair in NAME_HINTS for x in pair])
    by_part = F.coalesce(*[F.when(F.contains(name, F.lit(h)), F.lit(label)) for h, label in NAME_HINTS])
    words = F.split(F.replace(F.lower(F.coalesce("comment", F.lit(""))), F.lit(","), F.lit(" ")), r"\s+")
    in_comment = F.filter(words, lambda w: w.isin(*sorted(taxonomy.KEYS)))
    found = F.when(F.map_contains_key(exact, name), F.array(F.try_element_at(exact, name))).otherwise(
        F.concat(F.array_compact(F.array(by_part)), in_comment)
    )
    return columns.select("urn", F.explode(found).alias("label")).distinct()


# --------------------------------------------------------------------------- samples


def sampleable(df: DataFrame) -> list[str]:
    """Columns worth reading for a sample; all of them if nothing else is left."""
    kept = [f.name for f in df.schema if not is_vector(f.dataType)]
    return kept or df.columns


def sample(df: DataFrame, limit: int | None, keys: Sequence[str] | None = None) -> DataFrame:
    """``limit`` rows spread over the whole table, the same on every run; all of them without a limit.

    Rows are taken in the order of a digest of ``keys``, or of all columns that can be hashed. Every
    task keeps its own first ``limit`` rows, so nothing larger is brought together. Vectors are not read.
    """
    narrow = df.select(*dict.fromkeys([*(keys or ()), *sampleable(df)]))
    if limit is None:
        return narrow
    if keys is not None:
        return narrow.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), *keys).limit(limit)
    hashed = [f.name for f in narrow.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return narrow.orderBy(F.xxhash64(*hashed) if hashed else F.monotonically_increasing_id()).limit(limit)


def payload_page(df: DataFrame, payload: str, order: Sequence[str], limit: int) -> DataFrame:
    """The first page of non-empty payloads, vectors left unread, with ``partial`` set if more follow."""
    narrow = df.select(*sampleable(df))
    page = narrow.orderBy(*order).limit(limit + 1)
    more = page.agg((F.count("*") > limit).alias("partial"))
    kept = narrow.orderBy(*order).limit(limit).where(F.coalesce(F.col(payload), F.lit("")) != "")
    return kept.withColumn("_k", F.lit(1)).join(more.withColumn("_k", F.lit(1)), "_k").drop("_k")
