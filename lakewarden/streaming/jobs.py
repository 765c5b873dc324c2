"""Deciding, sealing, matching and counting on streams."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import audit, outcomes
from lakewarden.streaming.runs import Kept, each_batch, each_batch_keeping, folded


def decide_stream(requests: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch decision on every micro-batch.

    ``decide`` is called once per batch, so it can load policies and the catalog anew.
    """
    return each_batch(requests, "decided", decide)


class _Seal:
    """Chains the records of one stream, carrying sequence number and digest as state."""

    def __init__(self, key: bytes, state: str | None) -> None:
        self._key = key
        self._seq, self._prev = json.loads(state) if state else (0, audit.GENESIS)
        self._names = [c.split()[0] for c in audit.SEALED.split(", ")]

    def take(self, row: Any) -> list[tuple]:
        self._seq += 1
        body = f'{row.signed_head}{self._prev}","seq":{self._seq}{row.signed_tail}'
        digest = hmac.new(self._key, body.encode(), hashlib.sha256).hexdigest()
        given = {**vars(row), "seq": self._seq, "prev_hash": self._prev, "record_hash": digest}
        self._prev = digest
        return [tuple(given[n] for n in self._names)]

    def left(self) -> str:
        return json.dumps([self._seq, self._prev])


def seal_stream(records: DataFrame, key: bytes) -> DataFrame:
    """Seal a stream of audit records. Arrival order decides between batches, time within one.

    Records of one stream within one micro-batch pass through one task, as a sorted flow; cut hot
    streams with ``audit.segmented``.
    """
    order = [F.col("timestamp").asc_nulls_last(), F.col("ordinal").asc_nulls_last()]

    def job(batch: DataFrame, kept: Kept) -> tuple[DataFrame, Kept]:
        made, heads = folded(audit.staged(batch), kept.get("heads"), "stream", order, lambda state: _Seal(key, state), audit.SEALED)
        return made, {"heads": heads}

    return each_batch_keeping(records, "sealed", audit.SEALED, job)[0]


def unmatched(decisions: DataFrame, reports: DataFrame, late: str, within: str = "24 hours") -> DataFrame:
    """Allow decisions with the report that came in time, or none once the time has passed.

    Both sides need event times: ``decided_at`` and ``reported_at``. The bound is what lets
    the state of old decisions go. Rows that arrive more than ``late`` behind the newest event time
    are not taken; the caller says how far out of order the source may be.
    """
    left = decisions.where(F.col("effect") == "allow").withWatermark("decided_at", late)
    right = reports.select(F.col("decision_id").alias("_id"), "reported_at", F.col("outcome").alias("reported")).withWatermark(
        "reported_at", late
    )
    near = (F.col("decision_id") == F.col("_id")) & (F.col("reported_at") >= F.col("decided_at")) & (
        F.col("reported_at") <= F.col("decided_at") + F.expr(f"interval {within}")
    )
    return left.join(right, near, "left_outer").select("decision_id", "decided_at", "reported_at", "reported")


def decision_metrics(decisions: DataFrame, at: str = "ts", width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Counts by effect and a cumulative latency histogram per time window.

    A stream needs ``late``: how far behind the newest event time a row may arrive and still count.
    """
    if decisions.isStreaming and late is None:
        raise ValueError("a stream of decisions needs a lateness")
    windowed = decisions.withWatermark(at, late) if decisions.isStreaming else decisions
    edges = [
        F.sum(F.when(F.col("latency_ms") <= e, 1).otherwise(0)).alias(f"le_{str(e).replace('.', '_')}")
        for e in outcomes.LATENCY_EDGES_MS
    ]
    return (
        windowed.groupBy(F.window(at, width).alias("w"), "effect")
        .agg(F.count("*").alias("n"), F.sum("redaction_count").alias("redactions"), *edges)
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "effect", "n", "redactions", *[
            f"le_{str(e).replace('.', '_')}" for e in outcomes.LATENCY_EDGES_MS
        ])
    )


def counted_metrics(rows: DataFrame, at: str, by: str, width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Rows per window and value of ``by``: findings by label, redactions by strategy, load errors by policy."""
    if rows.isStreaming and late is None:
        raise ValueError("a stream of rows needs a lateness")
    timed = rows.withWatermark(at, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


class _Expire:
    """Holds a pending ticket and lets event time run it out; a settled ticket leaves no state."""

    def __init__(self, state: str | None) -> None:
        self._due = None if state is None else int(state)

    def take(self, row: Any) -> list[tuple]:
        if row.kind == "opened":
            self._due = row.due_ms
        elif row.kind is not None and self._due is not None:
            status, self._due = "expired" if self._due <= row.at_ms else row.kind, None
            return [(row.approval_id, status)]
        return []

    def left(self) -> str | None:
        return None if self._due is None else str(self._due)


_SETTLED = "approval_id bigint, status string"


def settle_tickets(events: DataFrame, late: str) -> DataFrame:
    """Final status of tickets from a stream ``(approval_id, kind, at, expires_at)``.

    ``kind`` is ``opened``, ``granted`` or ``denied``. A vote after the expiry cannot grant,
    and a ticket without a vote expires when event time, less ``late``, passes it.
    """
    timed = events.select("approval_id", "kind", "at", F.unix_millis("at").alias("at_ms"), F.unix_millis("expires_at").alias("due_ms"))

    def mark_of(kept: Kept) -> int | None:
        return kept["mark"].first()["mark"] if kept else None

    def run_out(mark: int | None) -> Column:
        return F.coalesce(F.col("_state").cast("bigint") < F.lit(mark).cast("bigint"), F.lit(False))

    def job(batch: DataFrame, kept: Kept) -> tuple[DataFrame, Kept]:
        # The mark of a batch is what the ones before it reached, as a watermark moves between batches.
        mark = mark_of(kept)
        taken = batch if mark is None else batch.where(F.coalesce(F.col("at") > F.timestamp_millis(F.lit(mark)), F.lit(True)))
        settled, pending = folded(taken, kept.get("pending"), "approval_id", [F.col("at"), F.col("kind")], _Expire, _SETTLED)
        gone = run_out(mark)
        expired = pending.where(gone).select("approval_id", F.lit("expired").alias("status"))
        reached = batch.agg(F.unix_millis(F.max("at") - F.expr(f"interval {late}")).alias("mark"))
        marks = reached.select(F.greatest("mark", F.lit(mark).cast("bigint")).alias("mark"))
        return settled.unionByName(expired), {"pending": pending.where(~gone), "mark": marks}

    settled, kept = each_batch_keeping(timed, "settled", _SETTLED, job)
    if not kept:
        return settled
    last = kept["pending"].where(run_out(mark_of(kept))).select("approval_id", F.lit("expired").alias("status"))
    return settled.unionByName(last)
