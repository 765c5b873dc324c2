from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import conditions, enforce, policy
from lakewarden.operators import obligations as O
from lakewarden.operators.conditions import PolicyError, glob_regex


def asked(spark, **context):
    import json

    row = spark.createDataFrame([(json.dumps(context),)], "j string")
    return row.select(
        F.struct(F.lit("agent:a").alias("id"), F.lit("agent").alias("type"), F.try_variant_get(F.try_parse_json(F.lit('{"trust_tier":"low"}')), "$", "map<string,variant>").alias("attributes")).alias("principal"),
        F.lit("read").alias("action"),
        F.struct(F.lit(None).cast("string").alias("urn"), F.array(F.lit("pii.email")).alias("classifications")).alias("resource"),
        F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>").alias("context"),
        F.array().cast("array<string>").alias("findings"),
    )


CASES = [
    ("context.a", "eq", "x", {"a": "x"}, True),
    ("context.a", "eq", ["x"], {"a": ["x"]}, True),
    ("context.a", "eq", "x", {"a": ["x"]}, False),
    ("context.a", "eq", True, {"a": 1}, False),
    ("context.a", "eq", 1, {"a": 1.0}, True),
    ("context.a", "neq", "x", {}, True),
    ("context.a", "neq", "x", {"a": None}, True),
    ("context.a", "in", ["pii"], {"a": "pii.email"}, True),
    ("context.a", "in", ["pii"], {"a": "piix"}, False),
    ("context.a", "not_in", ["pii"], {}, True),
    ("context.a", "all_of", ["pii", "phi"], {"a": ["pii.x", "phi"]}, True),
    ("context.a", "all_of", ["pii"], {"a": []}, False),
    ("context.a", "all_of", [], {"a": ["z"]}, True),
    ("context.a", "none_of", ["x"], {"a": ["y", "z"]}, True),
    ("context.a", "glob", "pg://*.t?", {"a": "pg://a/b.t1"}, True),
    ("context.a", "glob", "[!a]*", {"a": "abc"}, False),
    ("context.a", "not_glob", "*", {"a": 5}, True),
    ("context.a", "regex", "b+", {"a": "abbc"}, True),
    ("context.a", "exists", True, {"a": None}, False),
    ("context.a", "exists", False, {}, True),
    ("context.a", "contains", "bb", {"a": ["abbc", 1]}, True),
    ("context.a", "startswith", ["z", "ab"], {"a": "abc"}, True),
    ("context.a", "endswith", "bc", {"a": "abc"}, True),
    ("context.a", "gt", 5, {"a": [1, 9]}, True),
    ("context.a", "gt", 0, {"a": True}, False),
    ("context.a", "lte", 5, {"a": "5"}, False),
    ("context.a", "count_gte", 2, {"a": [1, 2]}, True),
    ("context.a", "count_lte", 0, {}, True),
    ("context.a", "count_gte", 1, {"a": None}, True),
    ("context.a", "empty", True, {"a": []}, True),
    ("context.a", "empty", True, {"a": ""}, False),
    ("context.a.b.1", "eq", "y", {"a": {"b": ["x", "y"]}}, True),
    ("context.a.-1", "eq", "y", {"a": ["x", "y"]}, True),
    ("context.a.b", "exists", False, {"a": None}, True),
    ("principal.trust_tier", "eq", "low", {}, True),
    ("resource.urn", "exists", False, {}, True),
    ("resource.urn.x", "exists", False, {}, True),
    ("resource.classifications", "any_of", ["pii"], {}, True),
    ("findings", "empty", True, {}, True),
]


@pytest.mark.parametrize("selector, operator, operand, context, expected", CASES)
def test_conditions(spark, selector, operator, operand, context, expected):
    rows = asked(spark, **context)
    assert rows.select(conditions.where(rows, selector, operator, operand).alias("x")).first().x is expected


@pytest.mark.parametrize(
    "operator, operand", [("gt", "5"), ("gt", True), ("exists", 1), ("empty", "no"), ("regex", "x" * 513), ("like", "x")]
)
def test_unusable_operands_are_refused(spark, operator, operand):
    rows = asked(spark)
    with pytest.raises(PolicyError):
        conditions.where(rows, "context.a", operator, operand)


@pytest.mark.parametrize("glob, text, hit", [("a*", "abc", True), ("a?c", "a\nc", True), ("a.c", "abc", False), ("[ab]*", "b1", True), ("[!ab]*", "b1", False), ("a[", "a[", True), ("A", "a", False)])
def test_globs(spark, glob, text, hit):
    column = conditions.glob_regex_column(F.lit(glob))
    row = spark.range(1).select(F.lit(text).rlike(glob_regex(glob)).alias("a"), column.alias("g")).first()
    assert row.a is hit
    assert spark.range(1).select(F.lit(text).rlike(row.g).alias("b")).first().b is hit


def rule(key, effect, priority=100, match=None, **more):
    return {"key": key, "effect": effect, "priority": priority, "match": match or {}, **more}


def decide(spark, policies, **options):
    return policy.evaluate(asked(spark), policies, **options).first()


def test_ties_go_to_the_largest_key_and_listing_to_the_smallest(spark):
    row = decide(spark, [rule("a", "allow"), rule("b", "allow"), rule("c", "allow", 5)])
    assert row.determining_policy == "b" and row.matched_policies == ["a", "b", "c"]


def test_algorithms(spark):
    rules = [rule("deny", "deny", 1), rule("ask", "require_approval", 50), rule("ok", "allow", 90)]
    assert decide(spark, rules).effect == "deny"
    assert decide(spark, rules, algorithm="permit_overrides").effect == "allow"
    assert decide(spark, rules, algorithm="priority_ordered").effect == "allow"
    tie = [rule("a", "allow", 5), rule("b", "deny", 5), rule("c", "require_approval", 5)]
    assert decide(spark, tie, algorithm="priority_ordered").determining_policy == "b"


def test_nothing_matches(spark):
    row = decide(spark, [rule("a", "allow", match={"action": "write"})])
    assert row.effect == "deny" and row.reason == "no policy matched; applied the default effect 'deny'"


def test_broken_policy_is_an_error_not_a_gap(spark):
    row = decide(spark, [rule("a", "allow"), rule("b", "deny", match={"action": {"gt": "x"}})])
    assert row.effect == "allow" and len(row.policy_errors) == 1
    assert row.reason.endswith("; 1 policy/policies failed to evaluate")


def test_obligations_are_a_union_without_repeats(spark):
    cap = {"type": "limit", "max_rows": 5}
    rules = [
        rule("a", "allow", 9, obligations=[cap]),
        rule("b", "allow", 8, obligations=[cap, {"type": "watermark", "text": "w"}]),
        rule("c", "require_approval", 1, obligations=[{"type": "limit", "max_rows": 1}]),
    ]
    row = decide(spark, rules, algorithm="permit_overrides")
    assert [o.type for o in row.obligations] == ["limit", "watermark"]


def test_trace(spark):
    tree = {"any": [{"action": "write"}, {"all": [{"action": "read"}, {"not": {"principal.type": "agent"}}]}]}
    row = decide(spark, [rule("a", "allow", match=tree)], explain=True)
    trace = row.trace[0]
    assert not trace.matched and len(trace.conditions) == 3
    assert trace.reason == "action eq 'write' did not match (observed 'read')"


@pytest.mark.parametrize(
    "document",
    [
        rule("a", "deny", obligations=[{"type": "watermark", "text": "x"}]),
        rule("a", "allow", obligations=[{"type": "notify"}]),
        rule("a", "allow", obligations=[{"type": "redact"}]),
        rule("a", "allow", obligations=[{"type": "redact", "labels": ["nope"]}]),
        rule("a", "allow", obligations=[{"type": "limit", "max_rows": True}]),
        rule("a", "allow", obligations=[{"type": "require_purpose", "purposes": "x"}]),
        rule("a", "allow", obligations=[{"type": "route", "require": ["eu"]}]),
        rule("a", "maybe"),
    ],
)
def test_unusable_documents(document):
    good, errors = policy.usable([document])
    assert not good and len(errors) == 1


def test_mixed_nodes_are_refused(spark):
    with pytest.raises(PolicyError):
        policy.compile_match(asked(spark).schema, {"all": [], "action": "read"})
    with pytest.raises(PolicyError):
        policy.compile_match(asked(spark).schema, {"payload.x": "read"})


def test_evaluation_is_one_narrow_projection(spark):
    plan = policy.evaluate(asked(spark), [rule("a", "allow")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("text, cap, want", [("abc", 9, "abc"), ("abcdef", 3, "abc"), ("aé", 2, "a"), ("aé", 3, "aé"), ("😀b", 3, ""), ("b😀", 5, "b😀"), ("b😀c", 4, "b")])
def test_byte_caps_keep_characters_whole(spark, text, cap, want):
    got = spark.range(1).select(enforce.capped_bytes(F.lit(text), F.lit(cap)).alias("c")).first().c
    over = len(text.encode()) > cap
    assert got.text == (want + enforce.CUT_NOTICE if over else text)
    assert got.cut_bytes == (len(text.encode()) - cap if over else None)


def test_outstanding(spark):
    duties = O.literal([{"type": "redact", "labels": ["pii"]}, {"type": "watermark", "text": "x"}, {"type": "route", "to": "m"}])
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        enforce.outstanding(duties, none, ["route"]).alias("ran"),
        enforce.outstanding(duties, F.array(F.lit("redact")), ["route", "watermark"]).alias("not_run"),
    ).first()
    assert row.ran == ["watermark"] and row.not_run == ["redact"]


def test_no_filter_holds_a_copy_of_the_trace(spark, sf):
    """A filter below the rows of a trace would work it out on the files as they lie."""
    from lakewarden.plans import load

    plan = load()[0]["evaluation_trace"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("did not match" in line or "context.destination" in line for line in filters)


@pytest.mark.parametrize("algorithm", policy.ALGORITHMS)
def test_the_effect_alone_needs_no_list(spark, algorithm):
    """It is the effect of the winner of the list, and a filter on it builds no list of policies."""
    rows = spark.range(64).select(F.struct(*[((F.col("id") / 2**i).cast("long") % 2 == 1).alias(f"b{i}") for i in range(6)]).alias("context"))
    shapes = [("allow", 5), ("deny", 1), ("require_approval", 5), ("allow", 9), ("deny", 5), ("require_approval", 9)]
    policies = [{"key": f"k{i}", "effect": e, "priority": p, "match": {f"context.b{i}": True}, "obligations": []} for i, (e, p) in enumerate(shapes)]
    out = policy.evaluate(rows, policies, algorithm, "allow")
    of = {p["key"]: p["effect"] for p in policies} | {None: "allow"}
    seen = out.select("effect", "determining_policy").collect()
    assert len(seen) == 64 and all(r.effect == of[r.determining_policy] for r in seen)
    plan = out.where(F.col("effect") == "allow").select("context")._jdf.queryExecution().optimizedPlan().toString()
    assert "obligations" not in plan and "k0" not in plan


def test_listing_meets_in_shares(spark, sf, tmp_path):
    """Every pair of a share stands once, repeats included and nulls left out, in more tasks than the cores."""
    from lakewarden.plans import q_decide

    spark.createDataFrame([(i % 300 if i else None, "ECONOMY" if i % 2 else "LARGE") for i in range(310)], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i if i else None, ["MACHINERY", "BUILDING", "OTHER"][i % 3]) for i in range(250)], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    out = q_decide.tool_listing_filter(spark, str(tmp_path))
    parts = [(i % 300, i % 2) for i in range(1, 310)]
    wanted = [(p, c) for p, odd in parts for c in range(1, 250) if p % 100 == c % 100 and (c % 3 == 0 or (c % 3 == 1 and odd))]
    assert sorted(map(tuple, out.collect())) == sorted(wanted)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [share") == 2 and tasks > 8


@pytest.mark.parametrize("algorithm", policy.ALGORITHMS)
def test_pairs_are_decided_once_per_outcome_of_tests(spark, monkeypatch, algorithm):
    """The pairs of two tables are decided as their joined rows are, however many rows share a key or differ in value."""
    monkeypatch.setattr(policy, "BLOCK", 7)
    tiers = [None, "low", "mid", "top", "top.secret"]
    left = spark.createDataFrame([(i % 3 if i % 10 else None, i // 2, tiers[i % 5], i % 4 == 0) for i in range(60)], "share int, who int, tier string, clean boolean").select(
        "share", "who", F.struct("tier", F.concat(F.lit("u"), F.col("who")).alias("id")).alias("principal"), F.struct("clean").alias("env")
    )
    right = spark.createDataFrame([(i % 4 if i % 9 else None, i // 3, f"kind{i}", i) for i in range(90)], "share int, what int, kind string, rank int").select(
        "share", "what", F.struct("kind", "rank").alias("resource")
    )
    rules = [
        {"key": "a", "effect": "allow", "priority": 3, "match": {"any": [{"principal.tier": ["top", "mid"]}, {"resource.rank": {"gt": 40}}]}},
        {"key": "d", "effect": "deny", "priority": 7, "match": {"all": [{"resource.kind": {"glob": "kind?"}}, {"not": {"env.clean": True}}]}},
        {"key": "r", "effect": "require_approval", "priority": 5, "match": {"principal.id": {"exists": True}, "resource.rank": {"lt": 20}, "context.x": {"exists": False}}},
        {"key": "broken", "effect": "deny", "priority": 9, "match": {"resource.rank": {"near": 1}}},
        {"key": "off", "effect": "deny", "priority": 9, "enabled": False, "match": {}},
    ]
    met, evaluate = [], policy.evaluate
    monkeypatch.setattr(policy, "evaluate", lambda df, *rest: met.append(df.count()) or evaluate(df, *rest))
    for effect in ("allow", "deny", "require_approval"):
        wanted = evaluate(left.join(right, "share"), rules, algorithm).where(F.col("effect") == effect).select("what", "who", "share")
        got = policy.evaluate_pairs(left, right, ["share"], ["what", "who", "share"], rules, effect, algorithm)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and (got.count() or effect == "deny")
    assert max(met) <= 6 * 8
    with pytest.raises(ValueError, match="both sides have who"):
        policy.evaluate_pairs(left, right.withColumn("who", F.lit(1)), ["share"], ["who"], rules)


def test_shuffled_partitions_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from lakewarden import session

    spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SHARE", 20_000)
    assert session.spread(table).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    # A union of spread tables is not brought together again.
    assert session.spread(session.spread(table).unionByName(session.spread(table).where("x > 'a'"))).rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism


def test_spread_gives_every_core_the_same_number_of_partitions(spark, tmp_path, monkeypatch):
    from lakewarden import session

    spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SHARE", size // (cores + 2))
    assert session.spread(table).rdd.getNumPartitions() == 2 * cores


def test_what_tests_share_is_resolved_once(spark):
    import json

    from lakewarden.operators import policy

    rows = [(i, json.dumps(v)) for i, v in enumerate([None, 5, "5", [1, 70], ["a", 50], True, {"x": 60}, 60.5])]
    df = spark.createDataFrame([*rows, (99, None)], "id int, j string").select(
        "id", F.create_map(F.lit("amount"), F.try_parse_json("j")).alias("context"), F.lit("read").alias("action")
    )
    df = df.unionByName(df.where("id = 99").select(F.lit(100).alias("id"), F.create_map().cast("map<string,variant>").alias("context"), "action"))

    def rules(n):
        return [{"key": f"k{i}", "effect": "allow", "match": {"all": [{"context.amount": {"gt": 10 * i}}, {"context.amount": {"lt": 1000}}]}} for i in range(n)]

    def resolved(n):
        out = policy.evaluate(df, rules(n)).select("id", "effect", "matched_policies")
        return out._jdf.queryExecution().optimizedPlan().toString().count("variant_get(")

    assert resolved(8) == resolved(2)
    out = policy.evaluate(df, rules(8)).select("id", F.size("matched_policies").alias("n"), "effect")
    numbers = {1: [5], 3: [1, 70], 4: [50], 7: [60.5]}
    expected = {i: sum(any(x > 10 * k for x in numbers.get(i, [])) and any(x < 1000 for x in numbers.get(i, [])) for k in range(8)) for i in [*range(8), 99, 100]}
    assert {r.id: r.n for r in out.collect()} == expected
    assert {r.id for r in out.where("effect = 'allow'").collect()} == {i for i, n in expected.items() if n}
