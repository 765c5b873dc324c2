"""Duties an enforcement point carries out on requests and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import obligations as O

# The notice after a cut answer.
CUT_NOTICE = "\n\n[truncated by data governance policy]"


def capped_tokens(requested: Column, obligations: Column) -> Column:
    """The requested token budget, never above the tightest cap."""
    return F.least(requested, O.tightest(obligations, "max_tokens"))


def capped_rows(df: DataFrame, request: Sequence[str], order: Sequence[str], limit: Column) -> DataFrame:
    """The first ``limit`` rows of each request; a null limit keeps all.

    Rows are thinned in salted slices before the final numbering, so one request holding a
    third of all rows is cut down in parallel.
    """
    salted = df.withColumn("_limit", limit).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    slice_ = Window.partitionBy(*request, "_salt").orderBy(*order)
    whole = Window.partitionBy(*request).orderBy(*order)
    free = salted.where(F.col("_limit").isNull())
    bound = (
        salted.where(F.col("_limit").isNotNull())
        .withColumn("_n", F.row_number().over(slice_))
        .where(F.col("_n") <= F.col("_limit"))
        .withColumn("_n", F.row_number().over(whole))
        .where(F.col("_n") <= F.col("_limit"))
        .drop("_n")
    )
    return bound.unionByName(free).drop("_limit", "_salt")


def dropped_rows(df: DataFrame, request: Sequence[str], limit: Column) -> DataFrame:
    """How many rows each request loses to its limit."""
    sizes = df.withColumn("_limit", limit).groupBy(*request).agg(F.count("*").alias("n"), F.min("_limit").alias("cap"))
    return sizes.select(*request, F.greatest(F.col("n") - F.coalesce("cap", "n"), F.lit(0)).alias("dropped"))


def whole_characters(raw: Column) -> Column:
    """UTF-8 bytes without an incomplete last character, as text."""
    size = F.octet_length(raw)

    def byte(back: int) -> Column:
        at = F.substring(raw, size - back + 1, F.lit(1))
        return F.conv(F.hex(at), 16, 10).cast("int")

    keep = size
    for back, needs in ((3, 0xF0), (2, 0xE0), (1, 0xC0)):
        lead = F.when(size >= back, byte(back))
        # A lead byte that promises more bytes than follow it starts a broken character.
        keep = F.when(lead >= needs, size - back).otherwise(keep)
    return F.decode(F.substring(raw, F.lit(1), keep.cast("int")), "UTF-8")


def capped_bytes(text: Column, cap: Column) -> Column:
    """``(text, cut_bytes)``: text cut at a character boundary with a notice, or unchanged."""
    raw = F.encode(text, "UTF-8")
    over = F.octet_length(text) > cap
    cut = F.concat(whole_characters(F.substring(raw, F.lit(1), cap.cast("int"))), F.lit(CUT_NOTICE))
    return F.struct(
        F.when(F.coalesce(over, F.lit(False)), cut).otherwise(text).alias("text"),
        F.when(over, F.octet_length(text) - cap).alias("cut_bytes"),
    )


def watermarked(text: Column, obligations: Column) -> Column:
    """Each non-blank watermark text after a blank line."""
    marks = F.filter(
        F.transform(O.of_type(obligations, "watermark"), lambda o: F.trim(o["text"])),
        lambda t: F.length(t) > 0,
    )
    return F.aggregate(marks, text, lambda acc, mark: F.concat(acc, F.lit("\n\n"), mark))


def purpose_refusal(obligations: Column, declared: Column) -> Column:
    """Why a declared purpose is refused, or null. Every purpose duty must allow it."""
    failing = F.filter(
        O.of_type(obligations, "require_purpose"),
        lambda o: ~F.coalesce(F.array_contains(o["purposes"], declared), F.lit(False)),
    )
    first = F.get(failing, F.lit(0))["purposes"]
    return F.when(
        F.size(failing) > 0,
        F.concat(
            F.lit("the declared purpose '"),
            F.coalesce(declared, F.lit("")),
            F.lit("' is not among the purposes this policy permits ("),
            F.coalesce(F.nullif(F.array_join(first, ", "), F.lit("")), F.lit("none")),
            F.lit(")"),
        ),
    )


def outstanding(obligations: Column, unsupported: Column, can_satisfy: Sequence[str] = ()) -> Column:
    """Duties nobody in the exchange is going to carry out; any makes the allow a refusal."""
    by_decision = F.array_except(F.array(*[F.lit(t) for t in O.DONE_BY_DECISION]), unsupported)
    own = F.array(*[F.lit(t) for t in can_satisfy]).cast("array<string>")
    return F.array_except(F.array_except(O.types_of(obligations), by_decision), own)


def may_act_for(allowed: Column, principal: Column) -> Column:
    """Whether a caller with this allow list may speak for a principal."""
    fits = F.exists(
        allowed,
        lambda entry: (entry == principal)
        | (F.endswith(entry, F.lit("*")) & F.startswith(principal, F.left(entry, F.length(entry) - 1))),
    )
    return F.coalesce(F.size(allowed) <= 0, F.lit(True)) | F.coalesce(fits, F.lit(False))


def governed_answers(asked: DataFrame, answered: DataFrame, on: str = "correlation_id") -> DataFrame:
    """Requests and answers are decided apart; duties of both decisions bind the answer."""
    out = answered.select(on, F.col("effect").alias("answer_effect"), F.col("obligations").alias("_answer"))
    both = asked.select(on, F.col("effect").alias("request_effect"), F.col("obligations").alias("_asked")).join(out, on)
    delivered = (F.col("request_effect") == "allow") & (F.col("answer_effect") == "allow")
    return both.select(
        on,
        "request_effect",
        "answer_effect",
        delivered.alias("delivered"),
        F.when(delivered, O.merged(F.col("_asked"), F.col("_answer")))
        .otherwise(F.array().cast(O.OBLIGATIONS))
        .alias("obligations"),
    )
