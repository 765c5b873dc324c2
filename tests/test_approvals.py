from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from lakewarden.operators import approvals

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
ASKS = "decision_id long, fingerprint string, principal_id string, effect string, ts timestamp"
TICKETS = "fingerprint string, status string, expires_at timestamp"


def walked(asks, until, hours):
    """Ids that open a ticket, ask by ask."""
    out, ends = [], {}
    for i, f, _, effect, ts in sorted(asks, key=lambda r: (r[4], r[0])):
        if effect == "require_approval" and (until.get(f) is None or until[f] <= ts) and (f not in ends or ts >= ends[f]):
            out.append(i)
            ends[f] = ts + timedelta(hours=hours)
    return sorted(out)


@pytest.mark.parametrize("hours, span, slices", [(24, 40 * 24, 64), (1, 3000, 4), (24, 10, 64), (0.5, 700, 1)])
def test_parking_equals_a_walk(spark, hours, span, slices):
    rng = random.Random(span)
    names = ["hot"] * 10 + [f"f{i}" for i in range(15)] + [None]
    asks = [
        (i, rng.choice(names), "p", rng.choice(["require_approval"] * 4 + ["allow"]), BASE + timedelta(minutes=rng.choice([1, 30, 60]) * rng.randrange(span)))
        for i in range(1200)
    ]
    asks += [(5000 + i, "hot", "p", "require_approval", BASE + timedelta(hours=hours * i)) for i in range(300)]  # each just at the end before
    until = {"f1": BASE + timedelta(hours=5), "f2": datetime(9999, 1, 1, tzinfo=timezone.utc)}
    tickets = spark.createDataFrame([("f1", "pending", until["f1"]), ("f2", "pending", None), ("f3", "granted", None)], TICKETS)
    got = approvals.park(spark.createDataFrame(asks, ASKS).repartition(5), tickets, hours=hours, slices=slices).collect()
    assert sorted(r.decision_id for r in got) == walked(asks, until, hours)
    assert all(r.expires_at - r.created_at == timedelta(hours=hours) and r.status == "pending" for r in got)


def test_parking_nothing(spark):
    assert approvals.park(spark.createDataFrame([], ASKS), spark.createDataFrame([], TICKETS)).count() == 0
