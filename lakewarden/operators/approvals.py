"""Approval tickets: parking, resolving, checking and spending them.

Tickets: ``(approval_id, decision_id, status, fingerprint, requested_by, created_at,
expires_at, decided_by, resolved_at, redeemed_at, redeemed_by)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.crypto import iso_utc
from lakewarden.operators import policy
from lakewarden.session import cut

#: How long a ticket lives unless the caller says otherwise.
TICKET_HOURS = 24.0
#: Slices of a ticket's life in which the next ask is looked up.
SLICES = 64


def park(decided: DataFrame, tickets: DataFrame, at: str = "ts", hours: float = TICKET_HOURS, slices: int = SLICES) -> DataFrame:
    """New tickets for parked decisions: an ask opens one unless its fingerprint has a live ticket.

    A ticket lives ``hours``; an ask after its end opens the next. Every ask points to the first ask
    after its own end, and the chains from the first asks on are found by doubling these pointers, in as
    many rounds as the logarithm of the longest chain. Neither a fingerprint nor its chain is walked
    by one task: pointers are looked up within short slices of time, ``slices`` to a ticket's life.
    Asks of one time come in the order of their decision; a missing fingerprint is one of its own.
    """
    own = {"_live_until", "_ask", "_t", "_slice"}
    parked = decided.where(F.col("effect") == policy.APPROVE).select(
        "fingerprint", "decision_id", F.col("principal_id").alias("requested_by"), F.col(at).cast("timestamp").alias("created_at")
    )
    live = tickets.where(F.col("status") == "pending").groupBy("fingerprint").agg(
        F.max(F.coalesce("expires_at", F.to_timestamp(F.lit("9999-12-31")))).alias("_live_until")
    )
    life = round(hours * 3_600_000_000)
    width = max(1, life // slices)
    sliced = lambda t: F.floor(t / width)
    asks = parked.join(live, "fingerprint", "left").where(F.col("_live_until").isNull() | (F.col("_live_until") <= F.col("created_at")))
    asks = asks.withColumns({"_ask": F.monotonically_increasing_id(), "_t": F.unix_micros("created_at")}).withColumn("_slice", sliced(F.col("_t")))
    asks = cut(asks, "asks")
    chain = _chained(asks.select(F.col("fingerprint").alias("f"), "_slice", "_t", "decision_id", "_ask"), life, sliced)
    return (
        asks.join(chain.withColumnRenamed("id", "_ask"), "_ask", "left_semi")
        .drop(*own)
        .withColumn("status", F.lit("pending"))
        .withColumn("expires_at", F.col("created_at") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {hours * 3600})"))
    )


def _chained(asks: DataFrame, life: int, sliced: Callable[[Column], Column]) -> DataFrame:
    """Numbers (``id``) of the asks that open a ticket, among ``(f, _slice, _t, decision_id, _ask)``."""
    ask = F.struct("_t", "decision_id", "_ask")
    ends = F.col("_t") + life
    # Asks, and for each the place where its ticket ends; at one time the end comes first, so that the ask counts as after it.
    marks = asks.select("f", F.col("_slice").alias("s"), F.col("_t").alias("t"), ask.alias("ask"), F.lit(None).cast("long").alias("origin")).union(
        asks.select("f", sliced(ends), ends, F.lit(None).cast(asks.select(ask.alias("a")).schema["a"].dataType), "_ask")
    )
    # Backwards in time, the last ask seen is the next one.
    within = Window.partitionBy("f", "s").orderBy(F.col("t").desc(), F.col("origin").asc_nulls_first(), F.col("ask").desc())
    across = Window.partitionBy("f").orderBy(F.col("s").desc())
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = marks.groupBy("f", "s").agg(F.min("ask").alias("first")).select("f", "s", F.last("first", ignorenulls=True).over(earlier).alias("later"))
    near = marks.select("f", "s", "origin", F.last("ask", ignorenulls=True).over(upto).alias("near")).where("origin is not null")
    same = near["f"].eqNullSafe(later["f"]) & (near["s"] == later["s"])
    jumps = cut(
        near.join(later, same, "left").select("origin", F.coalesce("near", "later")["_ask"].alias("to")).where("to is not null"), "jumps"
    )
    reached = cut(asks.groupBy("f").agg(F.min(ask).alias("first")).select(F.col("first._ask").alias("id")), "reached")
    while True:
        more = cut(reached.join(jumps, F.col("id") == F.col("origin")).select(F.col("to").alias("id")).distinct(), "reached")
        if more.isEmpty():
            return reached
        reached = cut(reached.union(more), "reached")
        on = jumps.select(F.col("origin").alias("to"), F.col("to").alias("beyond"))
        jumps = cut(jumps.join(on, "to").select("origin", F.col("beyond").alias("to")), "jumps")


def redemption_error(fingerprint: Column, now: Column) -> Column:
    """Why a ticket in the row cannot be spent on a request, or null."""
    status = F.col("status")
    return (
        F.when(F.col("approval_id").isNull(), F.lit("no approval request"))
        .when(status == "pending", F.lit("the approval request is still awaiting a decision"))
        .when(status == "denied", F.lit("the approval request was denied"))
        .when(status != "granted", F.concat(F.lit("the approval request is "), status))
        .when(
            F.col("redeemed_at").isNotNull(),
            F.concat(
                F.lit("the approval was already redeemed at "),
                iso_utc(F.col("redeemed_at")),
                F.lit(" by "),
                F.coalesce("redeemed_by", F.lit("an unknown caller")),
            ),
        )
        .when(F.col("expires_at") <= now, F.concat(F.lit("the approval expired at "), iso_utc(F.col("expires_at"))))
        .when(
            F.coalesce(F.col("fingerprint"), F.lit("")) == "",
            F.lit("the approval carries no request binding and cannot be redeemed"),
        )
        .when(
            F.col("fingerprint") != fingerprint,
            F.lit(
                "the approval was granted for a different request; approvals authorise only the "
                "exact request a human reviewed"
            ),
        )
    )


def redeem(
    decided: DataFrame,
    tickets: DataFrame,
    policies: Iterable[Mapping[str, Any]],
    at: str = "ts",
    persisted: Column | None = None,
) -> DataFrame:
    """Turn parked requests that present a valid ticket into allows, spending it once.

    ``decided`` carries ``presented_id`` and ``request_fingerprint``. Of several valid
    presenters the earliest wins. A request that is not recorded cannot spend a ticket.
    Obligations are collected anew over the allow and approval policies that matched.
    """
    recorded = F.lit(True) if persisted is None else persisted
    offered = decided.join(
        tickets.select("approval_id", "status", "fingerprint", "expires_at", "redeemed_at", "redeemed_by", "decided_by", "resolved_at"),
        F.col("presented_id") == F.col("approval_id"),
        "left",
    )
    asks = (F.col("effect") == policy.APPROVE) & F.col("presented_id").isNotNull()
    error = F.when(~recorded, F.lit("an approval is spent by the decision that records it")).otherwise(
        redemption_error(F.col("request_fingerprint"), F.col(at))
    )
    judged = offered.withColumn("approval_error", F.when(asks, error)).withColumn(
        "_valid", asks & F.col("approval_error").isNull()
    )
    winners = judged.where("_valid").groupBy("presented_id").agg(
        F.min_by("decision_id", F.struct(F.col(at), F.col("decision_id"))).alias("_winner")
    )
    out = judged.join(winners, "presented_id", "left")
    spends = F.col("_valid") & (F.col("decision_id") == F.col("_winner"))
    late = F.col("_valid") & ~spends
    granted = F.concat(
        F.col("reason"),
        F.lit("; redeemed approval "),
        F.col("approval_id").cast("string"),
        F.lit(" granted by "),
        F.coalesce("decided_by", F.lit("an unrecorded approver")),
        F.lit(" at "),
        F.coalesce(iso_utc(F.col("resolved_at")), F.lit("None")),
    )
    return (
        out.withColumn("redeemed", F.coalesce(spends, F.lit(False)))
        .withColumn(
            "obligations",
            F.when(
                F.col("redeemed"),
                policy.duties_for(F.col("matched_policies"), policies, (policy.ALLOW, policy.APPROVE)),
            ).otherwise(F.col("obligations")),
        )
        .withColumn("reason", F.when(F.col("redeemed"), granted).otherwise(F.col("reason")))
        .withColumn("effect", F.when(F.col("redeemed"), policy.ALLOW).otherwise(F.col("effect")))
        .withColumn(
            "approval_error",
            F.when(late, F.lit("the approval was already redeemed by an earlier request")).otherwise(F.col("approval_error")),
        )
        .drop("_valid", "_winner", "status", "fingerprint", "expires_at", "redeemed_at", "redeemed_by", "decided_by", "resolved_at")
    )


def resolve(tickets: DataFrame, votes: DataFrame, at: str = "voted_at") -> DataFrame:
    """Tickets after the first vote on each: granted, denied, or expired if it came too late."""
    first = votes.groupBy("approval_id").agg(
        F.min_by(F.struct("grant", "voter", "note", F.col(at).alias("at")), F.struct(F.col(at), F.col("voter"))).alias("v")
    )
    joined = tickets.drop("decided_by", "decision_note", "resolved_at").join(first, "approval_id", "left")
    counts = (F.col("status") == "pending") & F.col("v").isNotNull()
    late = counts & F.coalesce(F.col("expires_at") <= F.col("v.at"), F.lit(False))
    settled = counts & ~late
    status = (
        F.when(late, "expired")
        .when(settled & F.col("v.grant"), "granted")
        .when(settled, "denied")
        .otherwise(F.col("status"))
    )
    return (
        joined.withColumn("decided_by", F.when(settled, F.col("v.voter")))
        .withColumn("decision_note", F.when(settled, F.col("v.note")))
        .withColumn("resolved_at", F.when(settled, F.col("v.at")))
        .withColumn("status", status)
        .drop("v")
    )


def redeemable(status: Column, redeemed_at: Column) -> Column:
    return (status == "granted") & redeemed_at.isNull()


def listing(tickets: DataFrame, decisions: DataFrame, status: str | None = "pending", limit: int | None = 50) -> DataFrame:
    """Tickets with the decision each belongs to, newest first; ``limit=None`` lists all."""
    out = tickets.where(F.col("status") == status) if status else tickets
    joined = out.join(
        decisions.select("decision_id", "action", "resource_urn", "principal_id", "determining_policy"), "decision_id"
    ).withColumn("redeemable", redeemable(F.col("status"), F.col("redeemed_at")))
    return joined if limit is None else joined.orderBy(F.desc("created_at"), "approval_id").limit(limit)


def expired(tickets: DataFrame, now: Column) -> DataFrame:
    """Pending tickets past their time."""
    return tickets.where((F.col("status") == "pending") & (F.col("expires_at") <= now))
