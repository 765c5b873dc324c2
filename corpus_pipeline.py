"""From raw documents to packed training sequences: five stages, each a written table.

Every stage takes the table its predecessor wrote and returns a table; its decisions take effect.
All but the last return the columns of ``documents``, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import common, langid, minhash, packing, pii, substring
from lakewarden.session import cut

#: The key of the pseudonyms; a deployment passes its own to ``pii.pseudonyms``.
PII_KEY = b"corpus-pipeline-example-key"


def _with_text(docs: DataFrame, text: F.Column, columns: list[str]) -> DataFrame:
    """``docs`` with another text, its length in ``n_chars`` where there is one, and ``columns`` only."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters (``und``) go."""
    model = langid.fit(langid.training_rows(docs))
    found = langid.predictor(spark, model)("text")
    return docs.where(found["lang"] != F.lit(langid.UNDETERMINED))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a number of its own for each row, and the number's column; ids may repeat or be null."""
    number = common.unused("row_number", docs.columns)
    return cut(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-numbered"), number


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the first by id, those without an id last."""
    rows, number = _numbered(docs)
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number))
    groups = minhash.near_duplicates(rows, number).select(F.col("doc_id").alias(number), F.col("component_id").alias("group"))
    first = rows.select(number, place.alias("place")).join(groups, number).groupBy("group").agg(F.min("place").alias("place"))
    return rows.hint("merge").join(first.select(F.col("place")[number].alias(number)), number, "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier window covers; a text left without any word goes."""
    rows, number = _numbered(docs)
    spans = common.unused("spans", rows.columns)
    found = substring.with_spans(rows, spans, row_col=number)
    rest = _with_text(found, F.when(F.col(spans).isNull(), F.col("text")).otherwise(substring.kept_text("text", spans)), [*docs.columns, spans])
    return rest.where(F.col(spans).isNull() | (F.col("text") != "")).select(docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in the place of validated personal data."""
    common.bounded_batches(spark)
    return _with_text(docs, pii.pseudonyms(PII_KEY)("text")["text"], docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("privacy", privacy),
    ("sequences", sequences),
]

#: No stage but the second has an equivalent in SQL; tests hold all of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
