"""Audit events from jobs: what changed between two snapshots, and what decisions and reports amount to.

Every function returns ``(event, subject, fields)``, where ``fields`` names what changed; ``records``
turns these into input for ``audit.seal``. Snapshots are joined on their key in full, so that a feed costs
one shuffle of either side; nothing is gathered but the label changes of one asset, which are at
most as many as there are labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.crypto import canonical_json
from lakewarden.operators import audit, outcomes

_NO_FIELDS = "array<string>"


def _comparable(column: Column, kind: T.DataType) -> Column:
    """The value itself, or a text where Spark compares no such values; maps are read by sorted keys."""
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(column))
        return F.when(column.isNotNull(), F.to_json(F.struct(keys, F.transform(keys, lambda k: F.try_element_at(column, k)))))
    return F.to_json(F.struct(column)) if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)) else column


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, change, fields, old, new)`` for every key that was created, updated or deleted.

    Columns of both tables are compared, null equal to null; those of one table alone are left out.
    A key stands once in either table; rows with a null key are nobody's and left out. Unchanged
    keys yield no row.
    """
    held = [c for c in after.columns if c in before.columns and c != key]
    if not held:
        raise ValueError("the snapshots share no column beside their key")
    sides = [side.where(F.col(key).isNotNull()).select(key, F.struct(*held).alias(name)) for side, name in ((before, "old"), (after, "new"))]
    test = lambda c: _comparable(F.col("old")[c], before.schema[c].dataType).eqNullSafe(_comparable(F.col("new")[c], after.schema[c].dataType))
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    fields = F.array_compact(F.array(*[F.when(there & ~test(c), F.lit(c)) for c in held]))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.size("fields") > 0, "updated")
    return (
        sides[0].join(sides[1], key, "full_outer").withColumn("fields", fields).select(key, change.alias("change"), "fields", "old", "new").where("change is not null")
    )


def _feed(rows: DataFrame, event: Column, subject: Column, fields: Column | None = None) -> DataFrame:
    fields = F.array().cast(_NO_FIELDS) if fields is None else fields
    return rows.select(event.alias("event"), subject.cast("string").alias("subject"), fields.alias("fields")).where("event is not null")


def assets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Assets registered, updated and deleted."""
    said = F.when(F.col("change") == "created", "asset.registered").when(F.col("change") == "deleted", "asset.deleted").otherwise("asset.updated")
    return _feed(changed(before, after, "urn"), said, F.col("urn"), F.col("fields"))


def classified(before: DataFrame, after: DataFrame) -> DataFrame:
    """Assets whose set of labels changed; ``fields`` lists ``+label`` and ``-label``, sorted."""
    old, new = (side.select("urn", "label").where("urn is not null and label is not null").distinct().withColumn(n, F.lit(True)) for side, n in ((before, "was"), (after, "is")))
    sign = F.when(F.col("was").isNull(), "+").when(F.col("is").isNull(), "-")
    moved = old.join(new, ["urn", "label"], "full_outer").withColumn("sign", sign).where("sign is not null")
    sets = moved.groupBy("urn").agg(F.array_sort(F.collect_list(F.concat("sign", "label"))).alias("fields"))
    return _feed(sets, F.lit("asset.classified"), F.col("urn"), F.col("fields"))


def principals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Principals created and updated; one that is gone is an update of the field ``removed``."""
    said = F.when(F.col("change") == "created", "principal.created").otherwise("principal.updated")
    fields = F.when(F.col("change") == "deleted", F.array(F.lit("removed"))).otherwise(F.col("fields"))
    return _feed(changed(before, after, "external_id"), said, F.col("external_id"), fields)


def policies(before: DataFrame, after: DataFrame) -> DataFrame:
    """Policies created, deleted, switched on or off by ``enabled``, and updated in any other field; the last two may meet."""
    rest = F.filter("fields", lambda f: f != "enabled")
    switched = F.array_contains("fields", "enabled")
    kind = F.when(F.col("new.enabled"), "policy.enabled").otherwise("policy.disabled")
    said = (
        F.when(F.col("change") == "created", F.array(F.lit("policy.created")))
        .when(F.col("change") == "deleted", F.array(F.lit("policy.deleted")))
        .otherwise(F.array_compact(F.array(F.when(switched, kind), F.when(F.size(rest) > 0, "policy.updated"))))
    )
    rows = changed(before, after, "key").select("key", rest.alias("rest"), F.explode(said).alias("event"))
    none = F.array().cast(_NO_FIELDS)
    return _feed(rows, F.col("event"), F.col("key"), F.when(F.col("event") == "policy.updated", F.col("rest")).otherwise(none))


def approvals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tickets asked for, granted, denied and redeemed since; one that is new may already be all that."""
    moved = lambda status: (F.col("new.status") == status) & ~F.coalesce(F.col("old.status") == status, F.lit(False))
    said = F.array_compact(
        F.array(
            F.when(F.col("change") == "created", "approval.requested"),
            F.when(moved("granted"), "approval.granted"),
            F.when(moved("denied"), "approval.denied"),
            F.when(F.col("new.redeemed_at").isNotNull() & F.col("old.redeemed_at").isNull(), "approval.redeemed"),
        )
    )
    return _feed(changed(before, after, "approval_id").select("approval_id", F.explode(said).alias("event")), F.col("event"), F.col("approval_id"))


def decisions(made: DataFrame) -> DataFrame:
    return _feed(made, F.lit("decision"), F.col("decision_id"))


def reports(told: DataFrame, order: str = "reported_at") -> DataFrame:
    """Outcomes as first reported, and reports that say otherwise later; repeats are no event."""
    said = F.when(F.col("verdict") == "recorded", "decision.outcome").when(F.col("verdict") == "conflict", "decision.outcome_conflict")
    return _feed(outcomes.reconcile(told, order), said, F.col("decision_id"), F.array("outcome"))


def records(feed: DataFrame, at: Column, actor: Column) -> DataFrame:
    """A feed as input of ``audit.seal``; events outside the vocabulary fail the job."""
    known = F.col("event").isin(*audit.EVENTS)
    event = F.when(known, F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown audit event "), F.col("event"))))
    payload = F.struct("fields")
    staged = feed.select(at.alias("timestamp"), event.alias("event"), actor.alias("actor"), "subject", payload.alias("payload"))
    ordinal = F.concat_ws("\n", "event", "subject")
    return staged.withColumn("payload", canonical_json(F.col("payload"), staged.schema["payload"].dataType)).withColumn("ordinal", ordinal)
