from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit, changes


def said(feed):
    return sorted((r.event, r.subject, tuple(r.fields)) for r in feed.collect())


def test_differences_of_nested_and_missing_values(spark):
    schema = "k long, a string, m map<string,string>, l array<int>, s struct<x:int>"
    before = spark.createDataFrame([(1, "x", {"p": "1", "q": "2"}, [1], (1,)), (2, None, None, None, None), (3, "c", {}, [], (3,)), (4, "d", {}, [], (4,)), (None, "n", None, None, None)], schema)
    after = spark.createDataFrame([(1, "x", {"q": "2", "p": "1"}, [1], (1,)), (2, None, {}, None, None), (3, None, {}, [2], (4,)), (5, "e", {}, [], None), (None, "n", None, None, None)], schema)
    got = {r.k: (r.change, r.fields) for r in changes.changed(before, after, "k").collect()}
    assert got == {2: ("updated", ["m"]), 3: ("updated", ["a", "l", "s"]), 4: ("deleted", []), 5: ("created", [])}
    assert changes.changed(before, before, "k").count() == 0
    assert changes.changed(before.limit(0), after.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        changes.changed(before.select("k"), after.select("k"), "k")


def test_events_of_policies_and_tickets(spark):
    schema = "key string, document string, enabled boolean"
    before = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", False), ("d", "1", True)], schema)
    after = spark.createDataFrame([("a", "1", False), ("b", "2", True), ("c", "2", True), ("e", "1", False)], schema)
    assert said(changes.policies(before, after)) == [
        ("policy.created", "e", ()),
        ("policy.deleted", "d", ()),
        ("policy.disabled", "a", ()),
        ("policy.enabled", "c", ()),
        ("policy.updated", "b", ("document",)),
        ("policy.updated", "c", ("document",)),
    ]
    schema = "approval_id long, status string, redeemed_at string"
    before = spark.createDataFrame([(1, "pending", None), (2, "pending", None), (3, "granted", None), (4, "pending", None)], schema)
    after = spark.createDataFrame([(1, "granted", None), (2, "denied", None), (3, "granted", "t"), (4, "expired", None), (5, "granted", "t")], schema)
    want = [("granted", "1"), ("denied", "2"), ("redeemed", "3"), ("requested", "5"), ("granted", "5"), ("redeemed", "5")]
    assert said(changes.approvals(before, after)) == sorted((f"approval.{e}", i, ()) for e, i in want)


def test_a_feed_is_sealed_and_verified(spark):
    rows = "urn string, label string"
    feed = changes.classified(spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], rows), spark.createDataFrame([("u", "b"), ("u", "c"), ("u", "c"), ("v", "a")], rows))
    assert said(feed) == [("asset.classified", "u", ("+c", "-a"))]
    log = changes.records(feed, F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.lit("user:x")).withColumn("stream", F.lit("default"))
    row = audit.seal(log, b"key").first()
    assert (row.event, row.seq, row.payload) == ("asset.classified", 1, '{"fields":["+c","-a"]}')
    odd = feed.withColumn("event", F.lit("no.such"))
    with pytest.raises(Exception, match="unknown audit event"):
        changes.records(odd, F.current_timestamp(), F.lit("x")).collect()
