from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakewarden.operators import catalog, discovery, routing
from lakewarden.operators import obligations as O
from lakewarden.sources import seeds, tables

CATALOG = {
    "assets": [
        {"urn": "pg://public.customers", "kind": "table", "attributes": {"tier": "gold"}, "classifications": [{"label": "pii.email", "source": "manual"}, {"label": "pii.email", "source": "scan", "confidence": 0.3}]},
        {"urn": "pg://public.*", "attributes": {"tier": "bronze", "zone": "eu"}, "classifications": ["confidential.internal"]},
        {"urn": "pg://*", "attributes": {"zone": "any", "wide": True}, "classifications": [{"label": "pii.email", "source": "imported", "confidence": 0.2}]},
        {"urn": "model://eu/a", "kind": "model", "attributes": {"region": "eu", "routing_priority": 20, "aliases": ["eu-llm"]}},
        {"urn": "model://eu/b", "kind": "model", "attributes": {"region": "eu", "routing_priority": 10, "aliases": "solo"}},
        {"urn": "model://us/c", "kind": "model", "attributes": {"region": "us"}},
        {"urn": "model://off/d", "kind": "model", "attributes": {"region": "eu", "routing_enabled": False}},
    ],
    "principals": [{"external_id": "agent:a", "type": "agent", "display_name": "A", "attributes": {"trust_tier": "low"}}],
}


def test_resolving(spark):
    assets, labels, _ = seeds.load_catalog(spark, CATALOG)
    names = spark.createDataFrame([("pg://public.customers",), ("pg://public.orders",), ("s3://x",), ("pg://public.customers",)], "urn string")
    out = {r.urn: r for r in catalog.resolve(names, assets, labels).collect()}
    exact = out["pg://public.customers"]
    assert exact.registered and exact.kind == "table" and exact.matched_patterns == ["pg://*", "pg://public.*"]
    assert exact.label_confidence == {"pii.email": 1.0, "confidential.internal": 1.0}
    text = catalog.resolve(names, assets, labels).select("urn", F.transform_values("attributes", lambda k, v: F.to_json(v)).alias("a"))
    attributes = {r.urn: {k: json.loads(v) for k, v in r.a.items()} for r in text.collect()}
    assert attributes["pg://public.customers"] == {"tier": "gold", "zone": "eu", "wide": True}
    assert attributes["pg://public.orders"]["tier"] == "bronze"
    assert not out["s3://x"].registered and out["s3://x"].kind == "object_store"


def test_resolving_has_no_cross_join(spark):
    assets, labels, _ = seeds.load_catalog(spark, CATALOG)
    names = spark.createDataFrame([("pg://public.customers",)], "urn string")
    plan = catalog.resolve(names, assets, labels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _tree(plan):
    return plan._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_covered_as_by_testing_every_pattern(spark):
    import random
    import re

    from lakewarden.operators.conditions import glob_regex

    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("ab/.:") for _ in range(n))
    names = sorted({word(draw.randint(0, 14)) for _ in range(300)} | {"a[b", "abababababababab", "é/ab", "a*b"})
    globs = {draw.choice(["*", "?", "", "[ab]", "[!a]"]) + word(draw.randint(0, 3)) + draw.choice(["*", "?", "**", "*[.:]"]) + word(draw.randint(0, 10)) + draw.choice(["", "*", "?*", "?"]) for _ in range(200)}
    globs = sorted(globs | {"*", "?", "**", "*a", "a*", "*abababababa*", "a*b", "*[b", "é*", "ab", "a.b", ""})
    want = {(n, g) for n in names for g in globs if re.search(r"[*?]", g) and n != g and re.match(glob_regex(g).replace("\\z", "\\Z"), n)}
    frames = [spark.createDataFrame([(x,) for x in [*rows, None, *rows[:3]]], "urn string") for rows in (names, globs)]
    for slices in (1, 5):
        got = catalog.covering_assets(*frames, slices=slices).collect()
        assert len(got) == len({(r.urn, r.asset_urn) for r in got})
        assert {(r.urn, r.asset_urn) for r in got if not r.is_exact} == want
        assert {r.urn for r in got if r.is_exact} == set(names) & set(globs)
    assert catalog.covering_assets(frames[0], frames[1].limit(0)).count() == 0
    assert catalog.covering_assets(frames[0].limit(0), frames[1]).count() == 0


def test_a_common_beginning_is_no_key_where_a_pattern_has_a_rarer_literal(spark):
    names = spark.range(3000).select(F.format_string("pg://db/%05d", "id").alias("urn"))
    globs = spark.range(50).select(F.format_string("pg://*%05d*", "id").alias("urn"))
    plan = catalog.covering_assets(names, globs)
    assert plan.count() == 50
    # Beside the beginning that all names share, each pattern has a run that one name holds.
    choices = globs.select("urn", F.inline(catalog.anchors(F.col("urn"))))
    assert {(r.place, len(r.text)) for r in choices.collect()} == {("start", 5), ("inside", 5)}


def test_resolving_reads_its_tables_once_and_plans_small(spark, tmp_path):
    assets, labels, _ = seeds.load_catalog(spark, CATALOG)
    names = spark.createDataFrame([("pg://public.customers",), (None,), ("",)], "urn string")
    out = catalog.resolve(names, assets, labels)
    assert [r.urn for r in out.collect()] == ["pg://public.customers"]
    assert _tree(out).count("Relation") == 1 and "Join" not in _tree(out)
    assert catalog.resolve(names.limit(0), assets, labels).count() == 0
    bare = catalog.resolve(names, assets.limit(0), labels).first()
    assert not bare.registered and bare.matched_patterns == [] and bare.kind == "table"


def route(spark, duties, original="model://us/c"):
    assets, labels, _ = seeds.load_catalog(spark, CATALOG)
    rows = spark.range(1).select(O.literal(duties).alias("obligations"), F.lit(original).alias("original"))
    return routing.with_route(rows, routing.model_table(assets, labels)).first().route


def why_not(spark, duties):
    assets, labels, _ = seeds.load_catalog(spark, CATALOG)
    asking = routing.with_ask(spark.range(1).select(O.literal(duties).alias("obligations")))
    return {r.urn: r.why for r in routing.rejections(routing.distinct_asks(asking), routing.model_table(assets, labels)).collect()}


def test_routes(spark):
    eu = {"type": "route", "require": {"region": "eu"}}
    r = route(spark, [eu])
    assert r.target == "model://eu/b" and r.redirected
    assert r.reason == "routed to model://eu/b because it satisfies region='eu'"
    lost = why_not(spark, [eu])
    assert lost["model://us/c"] == "region is 'us', policy requires one of: eu"
    assert lost["model://off/d"] == "routing is disabled for this model"
    stay = route(spark, [eu], "model://eu/a")
    assert stay.target == "model://eu/a" and not stay.redirected
    assert route(spark, [{"type": "route", "to": "eu-llm"}]).target == "model://eu/a"
    assert route(spark, [{"type": "route", "to": "solo"}]).target == "model://eu/b"
    both = route(spark, [eu, {"type": "route", "require": {"region": ["us", "ap"]}}])
    assert both.target is None and both.reason == "no registered model satisfies requirements region=[]"
    two = route(spark, [{"type": "route", "to": "x"}, {"type": "route", "to": "y"}])
    assert two.target is None and two.reason == "two policies name different routing targets: 'x' and 'y'"
    assert why_not(spark, [{"type": "route", "require": {"hosting": "vpc"}}])["model://eu/a"] == "declares no 'hosting'"
    named = route(spark, [{"type": "route", "to": "eu-llm", "require": {"region": "us"}}])
    assert named.target is None and route(spark, [{"type": "route", "to": "eu-llm", "require": {"region": "eu"}}]).target == "model://eu/a"
    assert route(spark, [{"type": "limit", "max_rows": 1}]) is None


def test_policies_load_and_refuse_repeats(spark):
    docs = [{"key": "a", "effect": "allow"}, {"key": "b", "effect": "deny", "enabled": False}]
    table = seeds.load_policies(spark, docs)
    assert {(r.key, r.enabled) for r in table.collect()} == {("a", True), ("b", False)}
    try:
        seeds.load_policies(spark, [docs[0], docs[0]])
    except ValueError as wrong:
        assert "duplicate policy keys: a" in str(wrong)
    else:
        raise AssertionError("a repeated key went through")


def test_an_unreadable_table_does_not_end_a_run(spark, sf, tmp_path):
    good = spark.createDataFrame([(1, "ann@example.com")], "id int, email string")
    path = str(tmp_path / "t")
    good.write.parquet(path)
    broken = spark.read.parquet(path)
    for file in (tmp_path / "t").glob("*.parquet"):
        file.write_bytes(b"")
    known = spark.createDataFrame([], "urn string")
    out = discovery.run(spark, {"good": good, "broken": broken}, "pg://x", known)["outcomes"].collect()
    by_urn = {r.urn: r for r in out}
    assert by_urn["pg://x.broken"].error and by_urn["pg://x.good"].error is None
    assert by_urn["pg://x.good"].labels_imported == ["pii.email"] and by_urn["pg://x.good"].labels_scanned == ["pii.email"]


def test_sampling_rules(spark):
    wide = spark.range(20_000).select("id", F.array(F.lit(1.0)).alias("v"))
    rows = tables.sample(wide, 50)
    assert rows.columns == ["id"] and rows.count() == 50
    assert rows.agg(F.max("id")).first()[0] > 10_000  # spread, not the head
    assert sorted(rows.collect()) == sorted(tables.sample(wide.repartition(3), 50).collect())
    assert tables.sample(wide, None).count() == 20_000 and tables.sample(wide, 10**6).count() == 20_000


def test_a_large_index_is_not_copied_to_the_driver(spark, tmp_path):
    """Many patterns take a small file, but not so the anchors and slices made of them."""
    rows = spark.range(3000)
    rows.select(F.concat(F.lit("*/part"), "id", F.lit("/*")).alias("urn")).write.parquet(f"{tmp_path}/globs")
    rows.select(F.concat(F.lit("s3://x/part"), "id", F.lit("/y")).alias("urn")).write.parquet(f"{tmp_path}/names")
    names, globs = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("names", "globs"))
    out = catalog.covering_assets(names, globs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("not is_exact and split(urn, '/')[3] = split(asset_urn, '/')[1]").count() == out.count() == 3000
