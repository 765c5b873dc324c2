"""Queries over condition operators and policy evaluation."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import conditions, obligations, policy, policy_index
from lakewarden.plans import derived
from lakewarden.plans.registry import add, query
from lakewarden.plans.requests import access_requests

# --------------------------------------------------------------------------- conditions


def _j(path: str) -> str:
    return f"json_extract(body, '$.{path}')"


def _items(path: str, kinds: str, cast: str) -> str:
    """The elements of one JSON kind behind a path, scalars counting as one element."""
    j = _j(path)
    ok = f"json_type(x) in ({kinds})"
    return (
        f"(case when {j} is null then [] when json_type({j}) = 'ARRAY' then"
        f" list_transform(list_filter(cast(json_extract({j}, '$[*]') as json[]), lambda x: {ok}), lambda x: {cast})"
        f" when json_type({j}) in ({kinds}) then [{cast.replace('x', j, 1) if cast.startswith('x') else cast.replace('(x ', '(' + j + ' ')}] else [] end)"
    )


def _strings(path: str) -> str:
    return _items(path, "'VARCHAR'", "(x ->> '$')")


def _numbers(path: str) -> str:
    return _items(path, "'UBIGINT', 'BIGINT', 'DOUBLE'", "cast((x ->> '$') as double)")


def _count(path: str) -> str:
    j = _j(path)
    return f"(case when {j} is null then 0 when json_type({j}) = 'ARRAY' then json_array_length({j}) else 1 end)"


def _any(path: str, test: str, numbers: bool = False) -> str:
    items = _numbers(path) if numbers else _strings(path)
    return f"(len(list_filter({items}, lambda v: {test})) > 0)"


def _token(value: str) -> str:
    return f"(v = '{value}' or starts_with(v, '{value}.'))"


def _scalar(path: str, value: str) -> str:
    j = _j(path)
    return f"coalesce(json_type({j}) = 'VARCHAR' and ({j} ->> '$') = '{value}', false)"


_IN = f"({_any('tier', _token('low') + ' or ' + _token('pii'))} or {_any('tier', 'v = 7', True)})"
# operator -> [(selector, operand, SQL)]
CONDITIONS: dict[str, list[tuple[str, Any, str]]] = {
    "eq": [
        ("tier", "low", _scalar("tier", "low")),
        ("tier", None, "coalesce(json_type(" + _j("tier") + ") = 'NULL', false)"),
        ("score", 7, f"({_j('score')} ->> '$') = '7'"),
    ],
    "neq": [("tier", "low", f"not {_scalar('tier', 'low')}"), ("none", 1, "true")],
    "in": [("tier", ["low", "pii", 7], _IN), ("load", [True], f"coalesce(json_type({_j('load')}) = 'BOOLEAN', false)")],
    "not_in": [("tier", ["low", "pii", 7], f"not {_IN}")],
    "any_of": [("tags", ["phi", "household"], _any("tags", _token("phi") + " or " + _token("household")))],
    "all_of": [
        ("tags", ["phi", "household"], f"({_any('tags', _token('phi'))} and {_any('tags', _token('household'))})"),
        ("tier", ["low"], _any("tier", _token("low"))),
    ],
    "none_of": [("tags", ["phi"], f"not {_any('tags', _token('phi'))}")],
    "glob": [
        ("path", "pg://*/t1?", _any("path", "regexp_full_match(v, 'pg://.*/t1.')")),
        ("path", ["*[!0-4]", "pg://HOUSE*"], _any("path", "regexp_full_match(v, '.*[^0-4]')")),
    ],
    "not_glob": [("tags", "*old", f"not {_any('tags', 'ends_with(v, $$old$$)')}")],
    "regex": [("path", "t1[0-5]$", _any("path", "regexp_matches(v, 't1[0-5]$')"))],
    "exists": [
        ("tier", True, f"({_j('tier')} is not null and json_type({_j('tier')}) <> 'NULL')"),
        ("tags", False, f"{_j('tags')} is null"),
    ],
    "contains": [("path", ["build", "t7"], _any("path", "contains(v, 'build') or contains(v, 't7')"))],
    "startswith": [("tags", ["phi", "m"], _any("tags", "starts_with(v, 'phi') or starts_with(v, 'm')"))],
    "endswith": [("path", "/t3", _any("path", "ends_with(v, '/t3')"))],
    "gt": [("score", 90, _any("score", "v > 90", True)), ("load", 9, _any("load", "v > 9", True))],
    "gte": [("score", 90, _any("score", "v >= 90", True)), ("load", 50, _any("load", "v >= 50", True))],
    "lt": [("score", 3, _any("score", "v < 3", True)), ("load", 2, _any("load", "v < 2", True))],
    "lte": [("score", 3, _any("score", "v <= 3", True)), ("load", 0.5, "false")],
    "count_gte": [("tier", 2, f"{_count('tier')} >= 2"), ("tags", 1, f"{_count('tags')} >= 1")],
    "count_lte": [("tier", 0, f"{_count('tier')} <= 0"), ("tags", 1, f"{_count('tags')} <= 1")],
    "empty": [("tags", True, f"{_count('tags')} = 0"), ("tier", False, f"{_count('tier')} <> 0")],
}


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "subjects")
    return rows.select("c_custkey", F.try_parse_json("body").alias("context"))


def _condition(operator: str, cases: list[tuple[str, Any, str]]) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = _subjects(spark, sf)
        tests = [
            conditions.where(rows, f"context.{path}", operator, operand).alias(f"case_{i}")
            for i, (path, operand, _) in enumerate(cases)
        ]
        return rows.select("c_custkey", *tests)

    cells = ", ".join(f"{sql} as case_{i}" for i, (_, _, sql) in enumerate(cases))
    add(
        f"condition_{operator}",
        build,
        f"select c_custkey, {cells} from (select c_custkey, cast(body as json) as body from {{subjects}}) t",
    )


for _operator, _cases in CONDITIONS.items():
    _condition(_operator, _cases)


@query(
    "path_resolve",
    "select c_custkey, json_extract_string(body, '$.deep.a.b') as inner_text, json_extract_string(body, '$.deep.l[0]') as first,"
    " json_extract_string(body, '$.deep.l[#-1]') as last, false as past_end, false as through_null, cast(null as varchar) as not_there"
    " from {subjects}",
)
def path_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted paths through objects and list positions, from either end."""
    rows = _subjects(spark, sf)

    def at(path: str):
        return F.get(conditions.select(rows.schema, f"context.{path}").strings, F.lit(0))

    def there(path: str):
        return conditions.select(rows.schema, f"context.{path}").present

    return rows.select(
        "c_custkey",
        at("deep.a.b").alias("inner_text"),
        at("deep.l.0").alias("first"),
        at("deep.l.-1").alias("last"),
        there("deep.l.9").alias("past_end"),
        there("tier.x").alias("through_null"),
        at("deep.z.z").alias("not_there"),
    )


# --------------------------------------------------------------------------- policy sets

#: A small set with every effect, a tie in priority, nested nodes and a disabled member.
POLICIES: list[dict[str, Any]] = [
    {"key": "deny-export", "name": "No export outside", "effect": "deny", "priority": 900,
     "match": {"all": [{"action": "export"}, {"context.destination": "external"}]}},
    {"key": "approve-analytics", "name": "Analytics of small sums", "effect": "require_approval", "priority": 430,
     "match": {"all": [{"context.purpose": {"startswith": "ana"}}, {"context.amount": {"lte": 75}}]},
     "obligations": [{"type": "require_purpose", "purposes": ["analytics"]}]},
    {"key": "allow-batch", "name": "Batches of small sums", "effect": "allow", "priority": 140,
     "match": {"all": [{"not": {"principal.type": "user"}}, {"context.amount": {"lt": 30}}, {"action": {"not_in": ["export", "return"]}}]},
     "obligations": [{"type": "redact", "labels": ["pci.iban"], "strategy": "mask"}, {"type": "limit", "max_rows": 100}]},
    {"key": "allow-big", "name": "Big amounts", "effect": "allow", "priority": 140,
     "match": {"any": [{"context.amount": {"gt": 100}}, {"principal.attributes.trust_tier": "high"}]},
     "obligations": [{"type": "limit", "max_rows": 100}, {"type": "watermark", "text": "big"}]},
    {"key": "allow-users", "name": "Users search", "effect": "allow", "priority": 300,
     "match": {"all": [{"principal.type": "user"}, {"any": []}]}},
    {"key": "deny-s3", "name": "Object stores closed", "effect": "deny", "priority": 250,
     "match": {"all": [{"resource.urn": {"glob": "s3://*"}}, {"not": {"any": [{"action": "read"}, {"context.purpose": {"exists": True}}]}}]}},
    {"key": "off", "name": "Switched off", "effect": "deny", "priority": 999, "enabled": False, "match": {}},
]

_BATCH = "principal_type <> 'user' and value < 30 and action not in ('export', 'return')"
MATCHES = f"""
matched as (select event_id, principal_type, action, urn,
  coalesce(action = 'export' and destination = 'external', false) as m_export,
  coalesce(starts_with(purpose, 'ana') and value <= 75, false) as m_analytics,
  ({_BATCH}) as m_batch,
  (value > 100 or coalesce(claimed_tier = 'high', false)) as m_big,
  principal_type = 'user' as m_users,
  (starts_with(urn, 's3://') and not (action = 'read' or purpose is not null)) as m_s3
  from {{requests}})"""

#: Keys of the matched policies in listing order: priority falling, key rising.
LISTED = (
    "list_filter([case when m_export then 'deny-export' end, case when m_analytics then 'approve-analytics' end,"
    " case when m_users then 'allow-users' end, case when m_s3 then 'deny-s3' end, case when m_batch then 'allow-batch' end,"
    " case when m_big then 'allow-big' end], lambda k: k is not null)"
)
#: Of equal priorities the larger key determines.
_ALLOW = "case when m_users then 'allow-users' when m_big then 'allow-big' when m_batch then 'allow-batch' end"
WINNER = {
    "deny_overrides": f"case when m_export then 'deny-export' when m_s3 then 'deny-s3' when m_analytics then 'approve-analytics' else {_ALLOW} end",
    "permit_overrides": f"coalesce({_ALLOW}, case when m_analytics then 'approve-analytics' when m_export then 'deny-export' when m_s3 then 'deny-s3' end)",
    "priority_ordered": "case when m_export then 'deny-export' when m_analytics then 'approve-analytics' when m_users then 'allow-users'"
    " when m_s3 then 'deny-s3' when m_big then 'allow-big' when m_batch then 'allow-batch' end",
}
EFFECT = "case when winner is null then 'deny' when starts_with(winner, 'allow') then 'allow' when starts_with(winner, 'deny') then 'deny' else 'require_approval' end"


def _decided(algorithm: str = "deny_overrides") -> str:
    return f"with {MATCHES.strip()}, won as (select *, {WINNER[algorithm]} as winner, {LISTED} as keys from matched), decided as (select *, {EFFECT} as effect from won)"


def _evaluated(spark: SparkSession, sf: str, **options: Any) -> DataFrame:
    return policy.evaluate(access_requests(spark, sf), POLICIES, **options)


@query("match_policies", _decided() + " select event_id as request_id, array_to_string(keys, ',') as matched, 6 as evaluated from decided")
def match_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Every matching policy per request, highest priority first, disabled ones left out."""
    out = _evaluated(spark, sf)
    return out.select(
        "request_id", F.array_join("matched_policies", ",").alias("matched"), F.col("policies_evaluated").alias("evaluated")
    )


def _algorithm(name: str) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return _evaluated(spark, sf, algorithm=name).select("request_id", "effect", "determining_policy")

    add(
        f"combine_{name}",
        build,
        _decided(name) + " select event_id as request_id, effect, winner as determining_policy from decided",
    )


for _name in WINNER:
    _algorithm(_name)


@query(
    "match_tree",
    "select event_id as request_id, true as all_empty, true as any_empty, true as nothing, false as negated,"
    " (action = 'read' and destination = 'external') is true as both_in_one, (action = 'read' or coalesce(destination = 'external', false)) as one_of,"
    " not (action = 'read' or coalesce(destination = 'external', false)) as none_of from {requests}",
)
def match_tree(spark: SparkSession, sf: str) -> DataFrame:
    """AND, OR, NOT and the empty node, which matches everything."""
    r = access_requests(spark, sf)
    either = {"any": [{"action": "read"}, {"context.destination": "external"}]}
    trees = {
        "all_empty": {"all": []},
        "any_empty": {"any": []},
        "nothing": {},
        "negated": {"not": {}},
        "both_in_one": {"action": "read", "context.destination": "external"},
        "one_of": either,
        "none_of": {"not": either},
    }
    return r.select("request_id", *[policy.compile_match(r.schema, t).passed.alias(n) for n, t in trees.items()])


@query(
    "condition_sugar",
    "select event_id as request_id, action = 'read' as scalar, action in ('read', 'search') as listed,"
    " (action = 'read' and event_id % 4 < 2) as several, (value > 50 and value <= 100) as bounds from {requests}",
)
def condition_sugar(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar means equality, a list membership, several operators all of them."""
    r = access_requests(spark, sf)
    trees = {
        "scalar": {"action": "read"},
        "listed": {"action": ["read", "search"]},
        "several": {"action": "read", "context.destination": {"in": ["external"]}},
        "bounds": {"context.amount": {"gt": 50, "lte": 100}},
    }
    return r.select("request_id", *[policy.compile_match(r.schema, t).passed.alias(n) for n, t in trees.items()])


@query(
    "selector_root",
    "select event_id as request_id, coalesce(claimed_tier = 'high', false) as spread, coalesce(claimed_tier = 'high', false) as spelled_out,"
    " principal_type = 'agent' as built_in, event_id % 10 = 3 as declared, true as urn_there, false as kind_there, event_id % 2 = 0 as hidden from {requests}",
)
def selector_root(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes are reachable with and without their prefix and hide built-in members."""
    r = access_requests(spark, sf)
    own = F.when(F.col("request_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("mine").cast("variant")))
    shadowed = r.withColumn(
        "resource", F.col("resource").withField("attributes", F.coalesce(own, F.col("resource.attributes")))
    )
    trees = {
        "spread": {"principal.trust_tier": "high"},
        "spelled_out": {"principal.attributes.trust_tier": "high"},
        "built_in": {"principal.type": "agent"},
        "declared": {"resource.classifications": {"any_of": ["pii"]}},
        "urn_there": {"resource.urn": {"exists": True}},
        "kind_there": {"resource.nope": {"exists": True}},
        "hidden": {"resource.kind": "mine"},
    }
    return shadowed.select(
        "request_id", *[policy.compile_match(shadowed.schema, t).passed.alias(n) for n, t in trees.items()]
    )


@query("default_effect", f"with {MATCHES.strip()} select event_id as request_id, case when len({LISTED}) = 0 then 'allow' else 'matched' end as effect from matched")
def default_effect(spark: SparkSession, sf: str) -> DataFrame:
    out = _evaluated(spark, sf, default_effect="allow")
    return out.select(
        "request_id", F.when(F.col("determining_policy").isNull(), F.col("effect")).otherwise("matched").alias("effect")
    )


#: Duties as text, duplicates once, in the order of the listing.
DUTIES = (
    "case effect when 'require_approval' then 'require_purpose:analytics' when 'allow' then concat_ws(' ',"
    " case when m_batch then 'redact:mask limit:100' when m_big then 'limit:100' end, case when m_big then 'watermark:big' end) else '' end"
)


def _duty_text(column: str):
    return F.array_join(
        F.transform(
            column,
            lambda o: F.concat(
                o["type"],
                F.lit(":"),
                F.coalesce(o["strategy"], o["max_rows"].cast("string"), o["text"], F.array_join(o["purposes"], ",")),
            ),
        ),
        " ",
    )


@query("obligation_union", _decided() + f" select event_id as request_id, {DUTIES} as duties from decided")
def obligation_union(spark: SparkSession, sf: str) -> DataFrame:
    """Duties of every matched policy with the winning effect; a deny has none."""
    return _evaluated(spark, sf).select("request_id", _duty_text("obligations").alias("duties"))


@query(
    "obligations_for_named",
    _decided()
    + " select event_id as request_id, concat_ws(' ', case when m_analytics then 'require_purpose:analytics' end,"
    " case when m_batch then 'redact:mask limit:100' when m_big then 'limit:100' end, case when m_big then 'watermark:big' end) as duties from decided",
)
def obligations_for_named(spark: SparkSession, sf: str) -> DataFrame:
    """Duties collected anew over named policies of two effects, as redeeming needs."""
    out = _evaluated(spark, sf)
    both = policy.duties_for(F.col("matched_policies"), POLICIES, ("allow", "require_approval"))
    return out.withColumn("both", both).select("request_id", _duty_text("both").alias("duties"))


_NAMES = "case winner " + " ".join(
    f"when '{p['key']}' then '''{p['name']}'' ({p['key']}, priority {p['priority']})'" for p in POLICIES
) + " end"


@query(
    "decision_reason",
    _decided()
    + f", o as (select *, list_sort(list_filter(keys, lambda k: k <> winner)) as others from decided)"
    f" select event_id as request_id, case when winner is null then 'no policy matched; applied the default effect ''deny''' else {_NAMES} ||"
    " ' produced ''' || effect || ''' under deny_overrides' || case when len(others) > 0 then '; also matched: ' || array_to_string(others, ', ') else '' end end"
    " || '; 1 policy/policies failed to evaluate' as reason from o",
)
def decision_reason(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, load_errors=["policy 'x' (v1) is invalid"]).select("request_id", "reason")


@query(
    "load_errors_carried",
    _decided() + " select event_id as request_id, 2 as errors, effect from decided",
)
def load_errors_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that cannot be used become errors on every decision."""
    broken = [
        {"key": "bad-duty", "effect": "allow", "match": {}, "obligations": [{"type": "notify"}]},
        {"key": "bad-deny", "effect": "deny", "match": {}, "obligations": [{"type": "watermark", "text": "x"}]},
    ]
    good, errors = policy.usable([*POLICIES, *broken])
    out = policy.evaluate(access_requests(spark, sf), good, load_errors=errors)
    return out.select("request_id", F.size("policy_errors").alias("errors"), "effect")


_TRACED = [p for p in POLICIES if p["key"] in ("deny-export", "allow-users", "allow-big")]


@query(
    "evaluation_trace",
    "with t as (select *, case when destination is null then 'None' else '''' || destination || '''' end as shown from {requests})"
    " select event_id as request_id, 'deny-export' as key, coalesce(action = 'export' and destination = 'external', false) as matched, 2 as tests,"
    " case when action <> 'export' then 'action eq ''export'' did not match (observed ''' || action || ''')'"
    " when coalesce(destination = 'external', false) then 'all conditions matched' else 'context.destination eq ''external'' did not match (observed ' || shown || ')' end as reason from t"
    " union all select event_id, 'allow-users', principal_type = 'user', 1, case when principal_type = 'user' then 'all conditions matched'"
    " else 'principal.type eq ''user'' did not match (observed ''' || principal_type || ''')' end from t",
)
def evaluation_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Per policy: matched or not, how many tests ran, and the first failure spelled out."""
    out = policy.evaluate(access_requests(spark, sf), _TRACED, explain=True)
    # Outer, as the planner else copies the whole trace into a filter below, on the few files as they lie.
    rows = out.select("request_id", F.explode_outer("trace").alias("t")).where(F.col("t.key") != "allow-big")
    return rows.select("request_id", "t.key", "t.matched", F.size("t.conditions").alias("tests"), "t.reason")


@query(
    "why_not_counts",
    "with t as (select action, destination from {requests}) select 'action' as selector, cast(count_if(action = 'export') as bigint) as passed, cast(count_if(action <> 'export') as bigint) as failed from t"
    " union all select 'context.destination', cast(count_if(coalesce(destination = 'external', false)) as bigint), cast(count_if(not coalesce(destination = 'external', false)) as bigint) from t",
)
def why_not_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Which tests of a policy hold and fail over all requests."""
    only = [p for p in POLICIES if p["key"] == "deny-export"]
    out = policy.evaluate(access_requests(spark, sf), only, explain=True)
    tests = out.select(F.explode(F.flatten(F.transform("trace", lambda t: t["conditions"]))).alias("c"))
    return tests.groupBy("c.selector").agg(
        F.count_if("c.passed").alias("passed"), F.count_if(~F.col("c.passed")).alias("failed")
    )


@query(
    "observed_summary",
    "select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as shown,"
    " case when n > 12 then 12 + 1 else n end as items from (select doc_id, text, len(string_split(text, ' ')) as n from {documents}) t",
)
def observed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Long strings and long lists cut to what a stored trace may hold."""
    docs = derived.table(spark, sf, "documents")
    words = F.split("text", " ")
    shown = conditions.quoted(F.col("text"))
    listed = conditions.summarised(F.transform(words, lambda w: F.lit("w")), F.size(words))
    return docs.select(
        "doc_id",
        F.substring(shown, F.lit(2), F.length(shown) - 2).alias("shown"),
        (F.size(F.split(listed, ", "))).alias("items"),
    )


_CANDIDATE = [*[p for p in POLICIES if p["key"] != "deny-s3"], {"key": "deny-returns", "name": "Returns closed", "effect": "deny", "priority": 950, "match": {"action": "return"}}]


@query(
    "simulate_change",
    _decided()
    + ", cand as (select *, action = 'return' as m_return, list_filter(keys, lambda k: k <> 'deny-s3') as keys2 from decided),"
    f" c2 as (select *, case when m_return or m_export then 'deny' when m_analytics then 'require_approval' when ({_ALLOW}) is not null then 'allow' else 'deny' end as new_effect from cand)"
    " select effect as baseline_effect, new_effect as effect, (effect <> new_effect or m_return or m_s3) as changed, count(*) as n from c2 group by 1, 2, 3",
)
def simulate_change(spark: SparkSession, sf: str) -> DataFrame:
    """Two policy sets over one scan, and the matrix of what changes."""
    out = policy.simulate(access_requests(spark, sf), _CANDIDATE, POLICIES)
    return out.groupBy("baseline_effect", "effect", "changed").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- stored sets

#: Policy documents at scale: one per part, some edited, some gone, some new.
_INCOMING = "select concat('part-', cast(p_partkey as string)) as key, concat(p_name, case when p_partkey % 5 = 0 then '!' else '' end) as document from {part} where p_partkey % 7 <> 0"
_STORED = "select concat('part-', cast(p_partkey as string)) as key, p_name as document from {part} where p_partkey % 11 <> 0"


@query(
    "policy_sync_diff",
    f"with i as ({_INCOMING}), s as ({_STORED}) select coalesce(i.key, s.key) as key, case when s.key is null then 'created'"
    " when i.key is null then 'removed' when i.document = s.document then 'unchanged' else 'updated' end as change from i full join s on i.key = s.key",
)
def policy_sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    return policy.sync_diff(derived.run(spark, sf, _INCOMING), derived.run(spark, sf, _STORED), prune=True)


_WRITES = "select concat('p', cast(user_id as string)) as key, props as document, cast(null as string) as change_note, event_type as changed_by, ts as written_at from {events}"
_HISTORY = "select concat('p', cast(user_id as string)) as key, cast(1 as int) as version, 'old' as document from {events} where user_id % 2 = 0 group by user_id"


@query(
    "policy_versions",
    f"with w as ({_WRITES}), h as (select key, max(version) as top from ({_HISTORY}) x group by 1),"
    " n as (select w.*, row_number() over (partition by key order by written_at) as turn from w)"
    " select n.key, cast(coalesce(top, 0) + turn as int) as version, document, case when top is null and turn = 1 then 'created' else 'updated' end as change_note, changed_by"
    " from n left join h using (key)",
)
def policy_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A new numbered version per write, continuing each policy's history."""
    out = policy.next_versions(derived.run(spark, sf, _HISTORY), derived.run(spark, sf, _WRITES))
    return out.select("key", F.col("version").cast("int").alias("version"), "document", "change_note", "changed_by")


@query(
    "latest_versions",
    f"with w as ({_WRITES}), n as (select *, row_number() over (partition by key order by written_at) as version, count(*) over (partition by key) as top from w)"
    " select key, version, changed_by from n where version = top",
)
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    history = policy.next_versions(
        derived.run(spark, sf, _HISTORY).limit(0), derived.run(spark, sf, _WRITES)
    )
    return policy.latest(history).select("key", F.col("version").cast("bigint").alias("version"), "changed_by")


@query(
    "versions_in_force",
    f"with w as ({_WRITES}) select key, row_number() over (partition by key order by written_at) as version,"
    " epoch_us(written_at) as valid_from, epoch_us(lead(written_at) over (partition by key order by written_at)) as valid_to from w",
)
def versions_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """The span of time each version governed."""
    history = policy.next_versions(derived.run(spark, sf, _HISTORY).limit(0), derived.run(spark, sf, _WRITES))
    spans = policy.in_force(history)
    return spans.select(
        "key",
        F.col("version").cast("bigint").alias("version"),
        F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_from"),
        F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"),
    )


VERSIONS = [
    {"key": "reads", "effect": "allow", "priority": 10, "match": {"action": "read"}, "valid_from": datetime(2024, 1, 1), "valid_to": datetime(2024, 1, 8)},
    {"key": "reads", "effect": "deny", "priority": 10, "match": {"action": ["read", "search"]}, "valid_from": datetime(2024, 1, 8), "valid_to": datetime(2024, 1, 20)},
    {"key": "reads", "effect": "allow", "priority": 10, "match": {}, "valid_from": datetime(2024, 1, 20), "valid_to": None},
    {"key": "agents", "effect": "require_approval", "priority": 5, "match": {"principal.type": "agent"}, "valid_from": datetime(2024, 1, 15), "valid_to": None},
]


@query(
    "replay_as_of",
    "with r as (select event_id, action, principal_type, ts < timestamp '2024-01-08' as v1, ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-20' as v2,"
    " ts >= timestamp '2024-01-20' as v3, ts >= timestamp '2024-01-15' and principal_type = 'agent' as a from {requests}),"
    " m as (select *, case when v1 and action = 'read' then 'allow' when v2 and action in ('read', 'search') then 'deny' when v3 then 'allow' end as reads from r)"
    " select event_id as request_id, case when reads = 'deny' then 'deny' when a then 'require_approval' else coalesce(reads, 'deny') end as effect,"
    " cast((reads is not null)::int + a::int as int) as matched from m",
)
def replay_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each request against the policy text in force when it was made."""
    out = policy.replay(access_requests(spark, sf), VERSIONS)
    return out.select("request_id", "effect", F.size("matched_policies").alias("matched"))


_USER = "case {u} % 3 when 0 then 'agent:' when 1 then 'user:' else 'service:' end, cast({u} as string)"
_EFFECT_OF = "case o_orderkey % 7 when 0 then 'deny' when 1 then 'require_approval' else 'allow' end"
#: A policy per order: equality, lists, prefixes, numbers, alternatives and negations, most on one principal.
_RULES = (
    "select o_orderkey as policy, concat('k', lpad(cast(o_orderkey as string), 9, '0')) as key, cast(null as string) as name,"
    f" cast(o_orderkey % 50 as int) as priority, {_EFFECT_OF} as effect, u, case o_orderkey % 5"
    " when 0 then concat('{{\"principal.id\":\"', who, '\"}}')"
    " when 1 then concat('{{\"principal.id\":[\"', who, '\",\"nobody\"],\"action\":\"export\"}}')"
    " when 2 then concat('{{\"all\":[{{\"resource.urn\":{{\"startswith\":\"pg://\"}}}},{{\"principal.id\":{{\"eq\":\"', who, '\"}}}}]}}')"
    " when 3 then concat('{{\"any\":[{{\"principal.id\":\"', who, '\",\"context.amount\":{{\"gt\":50}}}},{{\"principal.id\":\"', who, '\",\"action\":{{\"glob\":\"*e*r*\"}}}}]}}')"
    " else concat('{{\"all\":[{{\"principal.id\":\"', who, '\"}},{{\"not\":{{\"action\":[\"read\",\"search\"]}}}}]}}') end as match"
    f" from (select *, concat({_USER.format(u='u')}) as who from (select o_orderkey, o_custkey % 1000 as u from {{orders}}) o) w"
)
_RULE_HOLDS = (
    "case policy % 5 when 0 then true when 1 then action = 'export' when 2 then starts_with(urn, 'pg://')"
    " when 3 then coalesce(value > 50, false) or regexp_full_match(action, '.*e.*r.*') else action not in ('read', 'search') end"
)
#: What a table of matches ``m (event_id, policy, key, priority, effect)`` decides for all of ``r``.
_SETTLED = (
    " s as (select *, case effect when 'deny' then 2 when 'require_approval' then 1 else 0 end as strength from m),"
    " w as (select *, row_number() over (partition by event_id order by strength desc, priority desc, key desc) as place, count(*) over (partition by event_id) as n from s)"
    " select r.event_id as request_id, coalesce(effect, 'deny') as effect, key as determining_policy, cast(coalesce(n, 0) as int) as matched"
    " from r left join w on w.event_id = r.event_id and place = 1"
)
_INDEXED = ("principal.id", "principal.type", "action", "resource.urn", "context.amount")


def _decided_by_table(out: DataFrame) -> DataFrame:
    return out.select("request_id", "effect", "determining_policy", F.size("matched_policies").alias("matched"))


@query(
    "policies_indexed",
    f"with p as ({_RULES}), r as (select * from {{requests}}), m as (select event_id, policy, key, priority, effect from r join p on user_id = u where {_RULE_HOLDS})," + _SETTLED,
)
def policies_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against a policy per order, found through an index instead of one Column each."""
    table = derived.run(spark, sf, _RULES).withColumn("obligations", F.array().cast(obligations.OBLIGATIONS))
    return _decided_by_table(policy_index.evaluate(access_requests(spark, sf), table, _INDEXED))


#: A version per order, of forty policies; each holds until the next one of its policy.
_DATED = (
    "select policy, concat('line', cast(policy % 40 as string)) as key, cast(null as string) as name, cast(policy % 6 as int) as priority,"
    " case policy % 7 when 0 then 'deny' when 1 then 'require_approval' else 'allow' end as effect,"
    " case policy % 4 when 0 then '{{\"action\":\"read\"}}' when 1 then '{{\"action\":[\"read\",\"search\"],\"principal.type\":\"agent\"}}'"
    " when 2 then '{{\"context.amount\":{{\"gte\":50}}}}' else '{{}}' end as match,"
    " valid_from, lead(valid_from) over (partition by policy % 40 order by valid_from, policy) as valid_to"
    " from (select o_orderkey as policy, timestamp '2024-01-01 00:00:00' + interval '1' second * cast((o_orderkey * 7919) % 2592000 as int) as valid_from from {orders}) o"
)
_VERSION_HOLDS = (
    "case policy % 4 when 0 then action = 'read' when 1 then action in ('read', 'search') and principal_type = 'agent'"
    " when 2 then coalesce(value >= 50, false) else true end"
)


@query(
    "replay_versions",
    f"with p as ({_DATED}), r as (select * from {{requests}}),"
    f" m as (select event_id, policy, key, priority, effect from r join p on ts >= valid_from and ts < coalesce(valid_to, timestamp '9999-01-01') where {_VERSION_HOLDS}),"
    + _SETTLED,
)
def replay_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against the versions in force at their time, versions being rows of a history."""
    table = derived.run(spark, sf, _DATED).withColumn("obligations", F.array().cast(obligations.OBLIGATIONS))
    return _decided_by_table(policy_index.evaluate(access_requests(spark, sf), table, _INDEXED, at="ts"))


_LISTED = "select concat('k', lpad(cast(p_partkey as string), 7, '0')) as key, case p_partkey % 3 when 0 then 'allow' when 1 then 'deny' else 'require_approval' end as effect, p_size as priority, p_partkey % 4 <> 0 as enabled, case when p_partkey % 2 = 0 then p_brand else p_type end as tag from {part}"


@query(
    "policy_listing",
    f"select key, priority from ({_LISTED}) t where enabled and effect = 'allow' and tag = 'ECONOMY' order by priority desc, key limit 20 offset 3",
)
def policy_listing(spark: SparkSession, sf: str) -> DataFrame:
    """One page: filters, then priority order, then the cut."""
    table = derived.run(spark, sf, _LISTED).withColumn("tags", F.array("tag"))
    return policy.listing(table, enabled=True, effect="allow", tag="ECONOMY", limit=20, offset=3).select("key", "priority")


#: Free-form obligations per supplier, most of them broken in one way.
_DUTY_CASES = {
    0: '{{"type":"redact","labels":["pii"]}}',
    1: '{{"type":"notify"}}',
    2: '{{"type":"redact"}}',
    3: '{{"type":"redact","labels":["pii","nope"],"strategy":"blur"}}',
    4: '{{"type":"limit","max_rows":-1}}',
    5: '{{"type":"limit","max_rows":"10"}}',
    6: '{{"type":" Require_Purpose ","purposes":[]}}',
    7: '{{"type":"log"}}',
    8: '{{"type":"redact","labels":"pci","strategy":"TOKENIZE"}}',
    9: '{{"type":"watermark","text":"x"}}',
}
_DUTIES = (
    "select concat('s', cast(s_suppkey as string)) as key, case when s_suppkey % 4 = 0 then 'deny' else 'allow' end as effect, s_suppkey % 3 <> 0 as enabled, case s_suppkey % 10 "
    + " ".join(f"when {i} then '{d}'" for i, d in _DUTY_CASES.items())
    + " end as duty from {supplier}"
)


def _duty_table(spark: SparkSession, sf: str) -> DataFrame:
    return derived.run(spark, sf, _DUTIES).withColumn("obligations", F.array(F.try_parse_json("duty")))


@query(
    "obligation_shape_check",
    "with d as (select s_suppkey as k, concat('s', cast(s_suppkey as string)) as key, s_suppkey % 10 as c from {supplier})"
    " select key, 'deny carries obligations' as violation from d where k % 4 = 0"
    " union all select key, 'unknown type' from d where c in (1, 7)"
    " union all select key, 'missing field' from d where c = 2"
    " union all select key, 'unknown strategy' from d where c = 3 union all select key, 'unknown labels' from d where c = 3"
    " union all select key, 'limit not a whole number' from d where c in (4, 5)"
    " union all select key, 'purposes not a filled list' from d where c = 6",
)
def obligation_shape_check(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each stored obligation."""
    return policy.shape_violations(_duty_table(spark, sf))


@query(
    "removed_type_audit",
    "select concat('s', cast(s_suppkey as string)) as key, case when s_suppkey % 4 = 0 then 'deny' else 'allow' end as effect, s_suppkey % 3 <> 0 as enabled,"
    " case s_suppkey % 10 when 1 then 'notify' else 'log' end as type from {supplier} where s_suppkey % 10 in (1, 7)",
)
def removed_type_audit(spark: SparkSession, sf: str) -> DataFrame:
    return policy.removed_types(_duty_table(spark, sf))


@query("unusable_policies", "select concat('s', cast(s_suppkey as string)) as key from {supplier} where s_suppkey % 10 = 8 and s_suppkey % 3 <> 0")
def unusable_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Enabled policies that need tokens while no key is set."""
    return policy.needing_tokens(_duty_table(spark, sf))


