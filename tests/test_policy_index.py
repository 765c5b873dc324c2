from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import obligations, policy, policy_index
from lakewarden.plans.q_policy import CONDITIONS, POLICIES, VERSIONS, _subjects
from lakewarden.plans.requests import access_requests


def as_table(spark, policies):
    rows = [
        (i, p["key"], p.get("name", p["key"]), int(p.get("priority", 100)), p["effect"], json.dumps(p.get("match")), json.dumps([obligations.shaped(o) for o in p.get("obligations") or []]), p.get("valid_from"), p.get("valid_to"))
        for i, p in enumerate(policies)
    ]
    made = spark.createDataFrame(rows, "policy long, key string, name string, priority int, effect string, match string, o string, valid_from timestamp, valid_to timestamp")
    return made.withColumn("obligations", F.from_json("o", obligations.OBLIGATIONS)).drop("o")


def selectors_in(node):
    if isinstance(node, list):
        return {s for n in node for s in selectors_in(n)}
    out = set()
    for name, value in (node or {}).items():
        out |= selectors_in(value) if name in ("all", "any", "not", "conditions") else {name}
    return out


COLUMNS = ("request_id", "effect", "determining_policy", "matched_policies")


def decided(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS, F.to_json("obligations")).collect())


def test_all_operators_equal_the_projection(spark, sf):
    """Every operator over missing, null, scalar and listed values, plain and negated."""
    tests = [(f"context.{path}", op, operand) for op, cases in CONDITIONS.items() for path, operand, _ in cases]
    policies = [{"key": f"p{i}", "effect": "allow", "match": {s: {op: o}}} for i, (s, op, o) in enumerate(tests)]
    policies += [{"key": f"n{i}", "effect": "allow", "match": {"not": {s: {op: o}}}} for i, (s, op, o) in enumerate(tests)]
    policies += [{"key": "list", "effect": "allow", "match": {"context.tags": {"eq": ["building", "phi.mrn"]}}}]
    rows = _subjects(spark, sf).withColumnRenamed("c_custkey", "request_id")
    names = sorted({s for s, _, _ in tests})
    assert decided(policy_index.evaluate(rows, as_table(spark, policies), names)) == decided(policy.evaluate(rows, policies))


@pytest.mark.parametrize("algorithm", policy.ALGORITHMS)
def test_trees_obligations_and_algorithms(spark, sf, algorithm):
    more = [
        {"key": "tree", "effect": "deny", "priority": 3, "match": {"any": [{"all": [{"action": "read"}, {"not": {"principal.type": ["agent", "user"]}}]}, {"not": {"any": [{"action": ["read", "search"]}, {"context.amount": {"lt": 90}}]}}]}},
        {"key": "none", "effect": "allow", "priority": 3, "match": {"any": []}},
        {"key": "empty-list", "effect": "deny", "priority": 9, "match": {"action": []}},
    ]
    policies = [p for p in POLICIES if p.get("enabled", True)] + more
    names = sorted(selectors_in([p.get("match") for p in policies]))
    rows = access_requests(spark, sf)
    got = policy_index.evaluate(rows, as_table(spark, policies), names, algorithm=algorithm)
    assert decided(got) == decided(policy.evaluate(rows, policies, algorithm=algorithm))


@pytest.mark.parametrize("grain", [1, 3600, 10**7])
def test_versions_equal_the_replay_of_a_list(spark, sf, grain):
    rows = access_requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    names = ["action", "principal.type"]
    edge = rows.where("action = 'read'").orderBy("request_id").first()["ts"]
    dated = [*VERSIONS, {"key": "edge", "effect": "deny", "match": {}, "valid_from": edge, "valid_to": edge + datetime.timedelta(microseconds=1)}]
    got = policy_index.evaluate(rows, as_table(spark, dated), names, at="ts", grain=grain)
    assert decided(got) == decided(policy.replay(rows, dated))


@pytest.mark.parametrize("first, last", [(0, 16), (0, 1), (3, 3), (5, 4), (1, 15), (7, 8), (6, 23), (0, 1 << 24), (1, 1 << 24)])
def test_pieces_cover_once(spark, first, last):
    got = spark.range(1).select(policy_index.pieces(F.lit(first), F.lit(last)).alias("p")).first()["p"]
    spans = sorted((p["at"] << p["level"], (p["at"] + 1) << p["level"]) for p in got)
    assert len(spans) <= 48
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert (spans == []) if first >= last else (spans[0][0], spans[-1][1]) == (first, last)


def test_unusable_trees_are_listed_and_match_nothing(spark, sf):
    broken = [
        {"key": "a", "effect": "deny", "match": {"action": {"near": 1}}},
        {"key": "b", "effect": "deny", "match": {"context.x": {"gt": "1"}}},
        {"key": "c", "effect": "deny", "match": {"any": [], "all": []}},
        {"key": "d", "effect": "deny", "match": {"who": "x"}},
        {"key": "e", "effect": "deny", "match": {"action": {"regex": "a" * 600}}},
        {"key": "f", "effect": "allow", "match": None},
    ]
    table = as_table(spark, broken)
    assert {r["key"] for r in policy_index.faults(table).collect()} == set("abcde")
    got = policy_index.evaluate(access_requests(spark, sf), table, ["action"])
    assert {tuple(r["matched_policies"]) for r in got.select("matched_policies").distinct().collect()} == {("f",)}


def test_nothing_on_either_side(spark, sf):
    rows = access_requests(spark, sf)
    table = as_table(spark, POLICIES)
    assert policy_index.evaluate(rows.where("false"), table, ["action"], at="ts").count() == 0
    got = policy_index.evaluate(rows, table.where("false"), ["action"], at="ts")
    assert [r["effect"] for r in got.select("effect").distinct().collect()] == ["deny"]


def test_a_plan_does_not_grow_with_the_policies(spark, sf):
    def size(n):
        many = [{"key": f"k{i}", "effect": "allow", "match": {"principal.id": f"user:{i}"}} for i in range(n)]
        plan = policy_index.evaluate(access_requests(spark, sf), as_table(spark, many), ["principal.id"])
        return len(plan._jdf.queryExecution().analyzed().toString().splitlines())

    assert size(3) == size(300)


def test_slots_are_as_short_as_the_versions(spark):
    """Versions that come and go within an hour are not all met by every request of that hour."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda n: start + datetime.timedelta(seconds=n)
    versions = [{"key": "k", "effect": "allow", "match": {"action": "read"}, "valid_from": at(5 * i), "valid_to": at(5 * i + 5)} for i in range(400)]
    versions.append({"key": "open", "effect": "allow", "match": None, "valid_from": None, "valid_to": None})
    table = as_table(spark, versions)
    asked = spark.createDataFrame([(i, "read" if i % 2 else "write", at(i - 3)) for i in range(2010)] + [(9999, "read", None)], "request_id long, action string, ts timestamp")
    _, _, grain = policy_index._times(asked.select(F.col("ts").alias("time")), table, None)
    assert grain <= 5
    want = {(i, 400) for i in range(2010)} | {(i, (i - 3) // 5) for i in range(2010) if i % 2 and 0 <= i - 3 < 2000}
    for chosen in (None, 1, 7, 3600):
        got = policy_index.matches(asked, policy_index.compiled(table), ["action"], at="ts", grain=chosen).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = policy_index.matches(asked.limit(0), policy_index.compiled(table), ["action"], at="ts")
    assert none.count() == 0


def test_policies_that_test_the_same_are_matched_as_one(spark, sf, monkeypatch):
    """However many policies share a tree, it meets a request once; keys that repeat count as often as they stand."""
    trees = [{"action": "read"}, {"any": [{"principal.type": "agent"}, {"context.amount": {"gt": 50}}]}, None]
    effects = ["allow", "require_approval", "deny", "allow"]
    policies = [{"key": f"k{i:03}", "effect": effects[i % 4], "priority": i % 5, "match": trees[i % 3]} for i in range(60)]
    met, matches = [], policy_index.matches
    monkeypatch.setattr(policy_index, "matches", lambda r, p, *rest: met.append(p.count()) or matches(r, p, *rest))
    rows, table = access_requests(spark, sf).where("request_id < 200"), as_table(spark, policies)
    names = ["action", "principal.type", "context.amount"]
    assert decided(policy_index.evaluate(rows, table, names)) == decided(policy.evaluate(rows, policies))
    assert met == [3]
    twice = policy_index.evaluate(rows, table.unionByName(table), names).agg(F.sum(F.size("matched_policies"))).first()[0]
    assert twice == 2 * policy_index.evaluate(rows, table, names).agg(F.sum(F.size("matched_policies"))).first()[0]


def test_versions_of_a_time_are_met_as_a_list(spark, monkeypatch):
    """Lists decide as the index does, each tree is compiled once, and what has no short list is looked up."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda n: start + datetime.timedelta(milliseconds=n)
    trees = [{"action": "read"}, {"action": ["read", "search"], "principal.type": "agent"}, {"any": [{"action": "write"}, {"not": {"principal.type": "agent"}}]}, None, {"action": {"near": 1}}]
    effects = ["allow", "deny", "require_approval"]
    versions = [
        {"key": f"k{i % 7}", "effect": effects[i % 3], "priority": i % 5, "match": trees[i % 5], "valid_from": at(130 * (i // 2) - 900), "valid_to": at(130 * (i // 2) - 900 + (i % 4) * 500)}
        for i in range(200)
    ]
    versions += [{"key": "open", "effect": "allow", "match": {"action": "write"}}, {"key": "since", "effect": "deny", "priority": 200, "match": None, "valid_from": at(9000)}]
    versions += [{"key": f"burst{i}", "effect": effects[i % 3], "match": {"action": "read", "principal.type": f"t{i}"}, "valid_from": at(4000), "valid_to": at(4040 + i)} for i in range(30)]
    table = as_table(spark, versions)
    rows = [(i, ["read", "search", "write"][i % 3], ["agent", "t3", None][i % 7 % 3], at(37 * i - 1000)) for i in range(400)]
    rows += [(1000, "read", "agent", None), (None, "read", "agent", at(5000)), (None, "write", None, at(1))]
    repeated = [(7, "write", "t3", at(9500)), (7, "read", "agent", None), (9, "search", "agent", at(100))]

    def asked(some):
        made = spark.createDataFrame(some, "request_id long, action string, type string, ts timestamp")
        return made.withColumn("principal", F.struct("type")).drop("type")

    def run(some, policies=table, **kept):
        with monkeypatch.context() as patch:
            for name, value in kept.items():
                patch.setattr(policy_index, name, value)
            return decided(policy_index.evaluate(asked(some), policies, ["action", "principal.type"], at="ts"))

    met, matches = [], policy_index.matches

    def counted(requests, *rest):
        met.append(requests.count())
        return matches(requests, *rest)

    wanted = run(rows, _LISTED=0)
    assert len({r[1] for r in wanted}) == 3 and len(wanted) == 403
    assert run(rows, matches=None) == wanted
    for limits in ({"_LISTED": 20}, {"_TREES": 8}, {"_LIST_SLOTS": (1, 1), "_LISTED": 300}, {"_COPIED": 0, "matches": None}):
        assert run(rows, **{"matches": counted, **limits}) == wanted
    # Of those with a limit some requests are looked up, not all.
    assert len(met) >= 2 and all(0 < n < 200 for n in met)
    met.clear()
    assert run([*rows, *repeated], matches=counted) == run([*rows, *repeated], _LISTED=0) and met == [5]
    met.clear()
    twice = table.unionByName(table.where("policy < 9"))
    assert run(rows, twice, matches=counted) == run(rows, twice, _LISTED=0) != wanted and met == [403]
    compiled = policy_index._trees(table.withColumn("match", F.coalesce("match", F.lit("")))).count()
    assert compiled == 4 + 1 + 30
