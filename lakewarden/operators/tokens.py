"""Batch reversal of tokens, with the checks and the record it needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import crypto

# Fixed values of a reversal request: defaults of the parameters below.
MAX_TOKENS = 50
MIN_JUSTIFICATION = 3
MAX_JUSTIFICATION = 500


def accepted(
    tokens: DataFrame,
    max_tokens: int | None = MAX_TOKENS,
    min_justification: int = MIN_JUSTIFICATION,
    max_justification: int | None = MAX_JUSTIFICATION,
) -> DataFrame:
    """Tokens of acceptable requests. A request too large is counted, never gathered; None sets no limit."""
    size = F.length(F.coalesce("justification", F.lit("")))
    over = lambda value, most: F.lit(False) if most is None else value > most
    sizes = tokens.groupBy("request_id").agg(
        F.count("*").alias("requested"), F.min("justification").alias("justification")
    )
    refusal = (
        F.when(over(F.col("requested"), max_tokens), F.lit("too many tokens"))
        .when(size < min_justification, F.lit("justification too short"))
        .when(over(size, max_justification), F.lit("justification too long"))
        .otherwise(F.lit(""))
    )
    judged = sizes.withColumn("refused", refusal)
    return tokens.drop("justification").join(judged, "request_id")


def reverse(tokens: DataFrame, key: bytes, retired: Sequence[bytes] = (), **limits: int | None) -> DataFrame:
    """``(request_id, token, recovered, value)`` of the requests accepted under ``limits``."""
    live = accepted(tokens, **limits).where(F.col("refused") == "")
    out = live.select("request_id", "token", crypto.detoken(F.col("token"), key, retired).alias("value"))
    return out.withColumn("recovered", F.col("value").isNotNull())


def reversal_report(
    tokens: DataFrame, key: bytes, audit_key: bytes, retired: Sequence[bytes] = (), **limits: int | None
) -> DataFrame:
    """One row per request: counts and digests, never a value. Digest lists hold at most ``max_tokens``."""
    judged = accepted(tokens, **limits)
    fine = F.col("refused") == ""
    value = F.when(fine, crypto.detoken(F.col("token"), key, retired))
    digest = F.when(fine, F.left(crypto.content_digest(F.col("token"), audit_key), F.lit(16)))
    rows = judged.withColumn("_hit", value.isNotNull()).withColumn("_digest", digest)
    return rows.groupBy("request_id", "requested", "justification", "refused").agg(
        F.when(F.max(fine), F.count_if("_hit")).alias("recovered"),
        F.array_sort(F.collect_list("_digest")).alias("digests"),
    )
