"""Queries over whole decisions, routing, enforcement, outcomes and approvals."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import approvals, decide, enforce, outcomes, policy, routing
from lakewarden.operators import obligations as O
from lakewarden.plans import derived, oracle
from lakewarden.plans.q_catalog import COVER
from lakewarden.plans.registry import query
from lakewarden.plans.requests import (
    KEY,
    access_requests,
    asset_labels,
    catalog_assets,
    catalog_principals,
)

#: Two denials of equal priority, two that ask, four grants with a tie; numbers, globs and nested nodes.
POSTURE: list[dict[str, Any]] = [
    {"key": "large-sums-inside", "name": "Large sums stay inside", "effect": "deny", "priority": 72,
     "match": {"all": [{"context.amount": {"gt": 120}}, {"context.destination": {"in": ["external", "partner"]}}]}},
    {"key": "sealed-shelves", "name": "Sealed shelves", "effect": "deny", "priority": 72,
     "match": {"any": [
         {"resource.urn": {"glob": "s3://promo/*7"}},
         {"all": [{"findings": {"any_of": ["secret.jwt", "pci.iban"]}}, {"not": {"principal.type": "user"}}]},
     ]}},
    {"key": "wide-mixtures", "name": "Many kinds at once", "effect": "require_approval", "priority": 55,
     "match": {"classifications": {"count_gte": 4}}},
    {"key": "unexplained-exports", "name": "Exports say why", "effect": "require_approval", "priority": 54,
     "match": {"all": [{"action": {"startswith": "exp"}}, {"not": {"context.purpose": {"exists": True}}}]}},
    {"key": "small-us-models", "name": "Small sums on US models", "effect": "allow", "priority": 41,
     "match": {"all": [{"action": "infer"}, {"context.amount": {"lt": 60}}]},
     "obligations": [{"type": "route", "require": {"region": "us"}}, {"type": "redact", "labels": ["pii.ip_address"], "strategy": "drop"}]},
    {"key": "answers-out", "name": "Answers leave hashed", "effect": "allow", "priority": 33,
     "match": {"all": [{"action": "return"}, {"resource.urn": {"not_glob": "mcp://*"}}]},
     "obligations": [{"type": "redact", "labels": ["pii", "secret"], "strategy": "hash"}, {"type": "watermark", "text": "checked"}]},
    {"key": "desk-work", "name": "Desk work", "effect": "allow", "priority": 33,
     "match": {"all": [{"context.purpose": {"in": ["support", "analytics"]}}, {"not": {"principal.trust_tier": "untrusted"}}]},
     "obligations": [{"type": "redact", "labels": ["pci", "pii.phone"], "strategy": "mask"}, {"type": "limit", "max_results": 40}]},
    {"key": "quiet-reads", "name": "Quiet reads", "effect": "allow", "priority": 12,
     "match": {"all": [{"action": {"in": ["read", "search"]}}, {"findings": {"empty": True}}, {"classifications": {"none_of": ["phi"]}}]}},
]


def decided(spark: SparkSession, sf: str, policies: list[dict[str, Any]] = POSTURE, **options: Any) -> DataFrame:
    return decide.decide(
        access_requests(spark, sf),
        catalog_principals(spark, sf),
        catalog_assets(spark, sf),
        asset_labels(spark, sf),
        policies,
        KEY,
        **options,
    )


# --------------------------------------------------------------------------- the flagship

def _hash_sql() -> str:
    return f"'<' || label || ':' || left({oracle.hmac_sql(KEY, 'encode(label || $$:$$ || value)')}, 16) || '>'"


def _has(column: str, *families: str) -> str:
    tests = " or ".join(f"l = '{f}' or starts_with(l, '{f}.')" for f in families)
    return f"len(list_filter({column}, lambda l: {tests})) > 0"


_PAYLOADS = "(select distinct md5(payload) as id, payload as text, '' as hint from {requests} where payload is not null)"
FACTS = (
    "with " + COVER.strip() + ",\n" + oracle.scan_ctes(_PAYLOADS)
    + f""",
strong as (select * from kept where confidence >= 0.5),
pl as (select id, list_sort(list_distinct(list(label))) as labels, count(*) as n from strong group by 1),
rl as (select urn, list(label) as labels from known group by 1),
rk as (select c.urn, max(a.kind) as kind from cover c join {{assets}} a on a.urn = c.urn and c.is_exact group by 1),
facts as (
  select r.*, md5(payload) as pid, case when p.external_id is null then claimed_tier else p.trust_tier end as tier,
    list_sort(list_distinct(list_concat(coalesce(rl.labels, []), case when declared_label is null then [] else [declared_label] end))) as res,
    coalesce(pl.labels, []) as fnd, coalesce(pl.n, 0) as n_found,
    coalesce(rk.kind, case split_part(r.urn, '://', 1) when 'pg' then 'table' when 's3' then 'object_store' when 'model' then 'model' when 'mcp' then 'tool' end) as kind
  from {{requests}} r left join {{principals}} p on p.external_id = r.principal_id left join rl using (urn) left join rk using (urn) left join pl on pl.id = md5(payload)),
mixtures as (select *, list_distinct(list_concat(res, fnd)) as mixed from facts),
m as (select *,
  value > 120 and coalesce(destination = 'external', false) as m_large,
  urn like 's3://promo/%7' or ({_has('fnd', 'secret.jwt', 'pci.iban')} and principal_type <> 'user') as m_sealed,
  len(mixed) >= 4 as m_wide,
  starts_with(action, 'exp') and purpose is null as m_export,
  action = 'infer' and value < 60 as m_us,
  action = 'return' and not starts_with(urn, 'mcp://') as m_answer,
  coalesce(purpose in ('support', 'analytics'), false) and not coalesce(tier = 'untrusted', false) as m_desk,
  action in ('read', 'search') and len(fnd) = 0 and not ({_has('mixed', 'phi')}) as m_quiet from mixtures),
keyed as (select *, list_filter([case when m_large then 'large-sums-inside' end, case when m_sealed then 'sealed-shelves' end,
  case when m_wide then 'wide-mixtures' end, case when m_export then 'unexplained-exports' end, case when m_us then 'small-us-models' end,
  case when m_answer then 'answers-out' end, case when m_desk then 'desk-work' end, case when m_quiet then 'quiet-reads' end], lambda k: k is not null) as keys from m),
first_pass as (select *, case when m_sealed then 'sealed-shelves' when m_desk and not (m_large or m_wide or m_export or m_us) then 'desk-work' else coalesce(keys[1], '') end as top, case when len(keys) = 0 or m_large or m_sealed then 'deny'
  when m_wide or m_export then 'require_approval' else 'allow' end as effect1 from keyed),
us as (select urn, coalesce(rank, 1000000) as pri from {{assets}} where kind = 'model' and routable and zone = 'us'),
us_best as (select urn from us order by pri, urn limit 1),
final as (select f.*, case when effect1 = 'allow' and m_us then coalesce((select urn from us where us.urn = f.urn), (select urn from us_best)) end as target,
  case when effect1 = 'allow' and m_us and (select count(*) from us) = 0 then 'deny' else effect1 end as effect from first_pass f)"""
)
_RULE = (
    "case when effect <> 'allow' then null when m_us and label = 'pii.ip_address' then 'drop'"
    " when m_answer and split_part(label, '.', 1) in ('pii', 'secret') then 'hash'"
    " when m_desk and (split_part(label, '.', 1) = 'pci' or label = 'pii.phone') then 'mask' end"
)
#: Duties beyond the redaction, and the redaction where there was no payload to run it on.
_LEFT = (
    "case when effect <> 'allow' then '' else concat_ws(' ', case when m_desk then 'limit' end,"
    " case when payload is null and (m_us or m_answer or m_desk) then 'redact' end, {route} case when m_answer then 'watermark' end) end"
)
EDITS = (
    FACTS
    + f""",
pairs as (select f.event_id, f.payload, f.effect, s.label, s.s, s.e, s.value, {_RULE} as strategy from final f join strong s on s.id = f.pid where f.payload is not null),
edits as (select *, case strategy when 'mask' then '[REDACTED:' || label || ']' when 'hash' then {_hash_sql()} when 'drop' then '' end as r from pairs),
steps as (select event_id, list({{{{'t': '', 's': s, 'e': e, 'r': r}}}} order by s desc) filter (where strategy is not null) as es, count(strategy) as n,
  string_agg(distinct case when strategy is null then label end, ' ' order by case when strategy is null then label end) as left_over from edits group by 1)""".replace("{{{{", "{{").replace("}}}}", "}}")
)


@query(
    "decide_requests",
    EDITS
    + """ select f.event_id as request_id, f.effect, case when len(keys) > 0 then top end as determining_policy, array_to_string(keys, ' ') as matched,
  array_to_string(list_sort(list_distinct(list_concat(res, fnd))), ' ') as labels, cast(n_found as int) as finding_count,
  cast(case when f.effect = 'allow' then coalesce(n, 0) else 0 end as int) as redaction_count,
  case when f.effect = 'allow' and payload is not null then coalesce(left_over, '') else '' end as residual, target,
  md5(case when f.effect <> 'allow' or payload is null then null when es is null or len(es) = 0 then payload else list_reduce(list_prepend({{'t': payload, 's': 0::bigint, 'e': 0::bigint, 'r': ''}}, es),
    lambda a, x: {{'t': substr(a.t, 1, x.s) || x.r || substr(a.t, x.e + 1), 's': 0::bigint, 'e': 0::bigint, 'r': ''}}).t end) as delivered
  from final f left join steps using (event_id)""",
)
def decide_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an access request: enriched, classified, decided, routed and redacted."""
    out = decided(spark, sf)
    return out.select(
        "request_id",
        "effect",
        "determining_policy",
        F.array_join("matched_policies", " ").alias("matched"),
        F.array_join("classifications", " ").alias("labels"),
        "finding_count",
        "redaction_count",
        F.array_join("residual_labels", " ").alias("residual"),
        F.col("route.target").alias("target"),
        F.md5("payload_out").alias("delivered"),
    )


@query(
    "unsupported_duties",
    FACTS + f" select event_id as request_id, effect, {_LEFT.format(route="case when m_us then 'route' end,")} as unsupported from final",
)
def unsupported_duties(spark: SparkSession, sf: str) -> DataFrame:
    """Duties a decision did not carry out itself: redaction counts only if it ran over a whole payload."""
    out = decided(spark, sf)
    return out.select("request_id", "effect", F.array_join(F.array_sort("unsupported_obligations"), " ").alias("unsupported"))


@query("outstanding_duties", FACTS + f" select event_id as request_id, {_LEFT.format(route='')} as outstanding from final")
def outstanding_duties(spark: SparkSession, sf: str) -> DataFrame:
    """Duties left over for a point that can only route; any turns the allow into a refusal."""
    out = decided(spark, sf)
    left = enforce.outstanding(F.col("obligations"), F.col("unsupported_obligations"), ["route"])
    return out.select("request_id", F.array_join(F.array_sort(left), " ").alias("outstanding"))


@query(
    "route_or_deny",
    "with r as (select *, action = 'infer' as routed from {requests}), v as (select urn, coalesce(rank, 1000000) as pri from {assets} where kind = 'model' and routable and zone = 'us' and tier = 'on_prem'),"
    " b as (select urn from v order by pri, urn limit 1)"
    " select event_id as request_id, 'allow' as effect, case when routed then coalesce((select v.urn from v where v.urn = r.urn), (select urn from b)) end as target,"
    " case when routed then coalesce(r.urn not in (select urn from v), true) end as redirected from r",
)
def route_or_deny(spark: SparkSession, sf: str) -> DataFrame:
    """Two policies' requirements intersect; the model already asked for is kept if it will do."""
    rules = [
        {"key": "a", "effect": "allow", "match": {}, "obligations": []},
        {"key": "b", "effect": "allow", "match": {"action": "infer"}, "obligations": [{"type": "route", "require": {"region": ["us", "eu"]}}]},
        {"key": "c", "effect": "allow", "match": {"action": "infer"}, "obligations": [{"type": "route", "require": {"region": ["us", "ap"], "tier": "on_prem"}}]},
    ]
    out = policy.evaluate(access_requests(spark, sf), rules)
    out = decide.apply_routes(out, routing.model_table(catalog_assets(spark, sf), asset_labels(spark, sf)))
    return out.select("request_id", "effect", F.col("route.target").alias("target"), F.col("route.redirected").alias("redirected"))


@query(
    "route_unsatisfiable",
    "select event_id as request_id, case when event_type in ('click', 'view') then 'deny' else 'allow' end as effect,"
    " case event_type when 'click' then '; denied because no registered model satisfies requirements region=[]'"
    " when 'view' then '; denied because two policies name different routing targets: ''line1'' and ''line2''' else '' end as why from {events}",
)
def route_unsatisfiable(spark: SparkSession, sf: str) -> DataFrame:
    """A route nothing satisfies is a denial, never a fallback."""

    def rule(key: str, action: str, duty: dict[str, Any]) -> dict[str, Any]:
        return {"key": key, "effect": "allow", "priority": 10, "match": {"action": action}, "obligations": [{"type": "route", **duty}]}

    rules = [
        {"key": "all", "effect": "allow", "priority": 99, "match": {}},
        rule("a", "infer", {"require": {"region": "us"}}),
        rule("b", "infer", {"require": {"region": "eu"}}),
        rule("c", "read", {"to": "line1"}),
        rule("d", "read", {"to": "line2"}),
    ]
    out = policy.evaluate(access_requests(spark, sf), rules)
    out = decide.apply_routes(out, routing.model_table(catalog_assets(spark, sf), asset_labels(spark, sf)))
    why = F.regexp_extract("reason", r"(; denied because .*)$", 1)
    return out.select("request_id", "effect", why.alias("why"))


@query(
    "route_rejections",
    "with m as (select urn, routable, zone, alias from {assets} where kind = 'model')"
    " select urn, case when not routable then 'routing is disabled for this model' when alias <> 'line4' then 'does not answer to ''line4'''"
    " when zone is null then 'declares no ''region''' when zone <> 'eu' then 'region is ''us'', policy requires one of: eu' else 'viable' end as why,"
    " (select count(*) from {requests} where action = 'infer') as requests from m",
)
def route_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Why each model lost, over all routed requests."""
    rules = [{"key": "a", "effect": "allow", "match": {"action": "infer"}, "obligations": [{"type": "route", "to": "line4", "require": {"region": "eu"}}]}]
    out = policy.evaluate(access_requests(spark, sf), rules)
    asks = routing.distinct_asks(routing.with_ask(out).select("_key", "_ask"))
    lost = routing.rejections(asks, routing.model_table(catalog_assets(spark, sf), asset_labels(spark, sf)))
    return lost.select("urn", F.coalesce("why", F.lit("viable")).alias("why"), "requests")


@query(
    "token_guard",
    "select event_id as request_id, case when event_type = 'click' then 'deny' else 'allow' end as effect, case when event_type = 'click' then 1 else 0 end as errors from {events}",
)
def token_guard(spark: SparkSession, sf: str) -> DataFrame:
    """A decision that needs tokens without a key is a denial."""
    rules = [
        {"key": "all", "effect": "allow", "match": {}},
        {"key": "t", "effect": "allow", "match": {"action": "infer"}, "obligations": [{"type": "redact", "labels": ["pii"], "strategy": "tokenize"}]},
    ]
    out = decide.guard_tokens(policy.evaluate(access_requests(spark, sf), rules))
    return out.select("request_id", "effect", F.size("policy_errors").alias("errors"))


@query(
    "evidence_check",
    "select event_id as request_id, case when payload is not null and event_id % 3 = 0 then 'payload present but scanning is off'"
    " when payload is not null and event_id % 10 > 5 then 'confidence floor is above the ceiling' end as error from {requests}",
)
def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that suppress their own evidence are rejected."""
    r = access_requests(spark, sf)
    scanning = F.col("request_id") % 3 != 0
    floor = (F.col("request_id") % 10) / 10.0
    return r.select("request_id", decide.evidence_errors(r, scanning, floor).alias("error"))


@query(
    "fail_closed",
    "select event_id as request_id, case when event_id % 9 in (0, 1, 2) then 'deny' else 'allow' end as effect, case event_id % 9 when 0 then 'no principal'"
    " when 1 then 'action must have 1 to 64 characters' when 2 then 'unknown classification labels: made.up' else '' end as error from {events}",
)
def fail_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that cannot be judged are denied with the reason, not dropped."""
    r, kind = access_requests(spark, sf), F.col("request_id") % 9
    broken = (
        r.withColumn("principal", F.when(kind == 0, F.col("principal").withField("id", F.lit(None).cast("string"))).otherwise(F.col("principal")))
        .withColumn("action", F.when(kind == 1, F.repeat(F.lit("a"), F.lit(65))).otherwise(F.col("action")))
        .withColumn(
            "resource",
            F.when(kind == 2, F.col("resource").withField("classifications", F.array(F.lit("made.up")))).otherwise(F.col("resource")),
        )
    )
    out = policy.evaluate(broken, [{"key": "all", "effect": "allow", "match": {}}])
    out = decide.fail_closed(out, decide.request_errors(out))
    return out.select("request_id", "effect", F.array_join("policy_errors", ",").alias("error"))


@query("payload_digest", "select event_id as request_id, " + oracle.hmac_sql(KEY, "encode(payload)") + " as digest from {requests}")
def payload_digest(spark: SparkSession, sf: str) -> DataFrame:
    r = access_requests(spark, sf)
    return r.select("request_id", decide.payload_digest(F.col("payload"), KEY).alias("digest"))


_CONTEXT = "'\"amount\":' || cast(value as varchar) || case when destination is null then '' else ',\"destination\":\"' || destination || '\"' end || case when purpose is null then '' else ',\"purpose\":\"' || purpose || '\"' end"
_BODY = (
    "'{{\"action\":\"' || action || '\",\"classifications\":[' || case when declared_label is null then '' else '\"' || declared_label || '\"' end || '],\"context\":{{' || " + _CONTEXT
    + " || '}},\"findings\":[],\"payload\":' || case when payload is null then 'null' else '\"' || " + oracle.hmac_sql(KEY, "encode(payload)")
    + " || '\"' end || ',\"principal_id\":\"' || principal_id || '\",\"principal_type\":\"' || principal_type || '\",\"resource_urn\":\"' || urn || '\"}}'"
)


@query(
    "request_fingerprint",
    f"select event_id as request_id, {oracle.hmac_sql(KEY, 'encode(b)')} as fingerprint from (select event_id, {_BODY} as b from {{requests}}) t",
)
def request_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The digest an approval is bound to: everything a reviewer agreed to."""
    r = access_requests(spark, sf).withColumn("findings", F.array().cast("array<string>"))
    r = r.withColumn("payload_digest", decide.payload_digest(F.col("payload"), KEY))
    return r.select("request_id", decide.fingerprint(r, KEY).alias("fingerprint"))


@query(
    "distinct_questions",
    "with q as (select principal_id, action, urn, coalesce(declared_label, '') as l, coalesce(destination, '') as d, coalesce(purpose, '') as p, value, count(*) as n, min(event_id) as first_id from {requests} where payload is null group by all)"
    " select first_id as request_id, n as asked from q",
)
def distinct_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Payload-free requests that ask the same question are decided once."""
    r = access_requests(spark, sf)
    once = decide.distinct_questions(r)
    asked = r.where(F.col("payload").isNull()).groupBy(decide.question_key(r).alias("question")).agg(F.count("*").alias("asked"))
    return once.join(asked, "question").select("request_id", "asked")


@query(
    "decision_records",
    FACTS + " select event_id as request_id, principal_id, action, urn as resource_urn, effect, cast(n_found as int) as finding_count, value as amount from final",
)
def decision_records(spark: SparkSession, sf: str) -> DataFrame:
    """The stored form: no payload, no matched value."""
    out = decide.records(decided(spark, sf), ["request_id"])
    return out.select(
        "request_id", "principal_id", "action", "resource_urn", "effect", "finding_count", F.col("context")["amount"].cast("double").alias("amount")
    )


# --------------------------------------------------------------------------- enforcement

#: Limits and marks on every event, as a decision would hand them over.
def _limited(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        {"key": "a", "effect": "allow", "priority": 3, "match": {}, "obligations": [{"type": "limit", "max_tokens": 500, "max_results": 3, "max_bytes": 400}]},
        {"key": "b", "effect": "allow", "priority": 2, "match": {"action": "infer"}, "obligations": [{"type": "limit", "max_tokens": 90, "max_bytes": 100}, {"type": "watermark", "text": " marked "}]},
        {"key": "c", "effect": "allow", "priority": 1, "match": {"action": ["infer", "read"]}, "obligations": [{"type": "watermark", "text": "  "}, {"type": "watermark", "text": "twice"}, {"type": "require_purpose", "purposes": ["support", "analytics"]}]},
    ]
    return policy.evaluate(access_requests(spark, sf), rules)


@query(
    "tightest_limit",
    "select event_id as request_id, case when action = 'infer' then 90 else 500 end as max_tokens, case when action = 'infer' then 100 else 400 end as max_bytes, 3 as max_results from {requests}",
)
def tightest_limit(spark: SparkSession, sf: str) -> DataFrame:
    cells = [O.tightest(F.col("obligations"), n).alias(n) for n in ("max_tokens", "max_bytes", "max_results")]
    return _limited(spark, sf).select("request_id", *cells)


@query(
    "capped_tokens",
    "select event_id as request_id, case when event_id % 4 = 0 then case when action = 'infer' then 90 else 500 end else least(event_id % 800, case when action = 'infer' then 90 else 500 end) end as max_tokens from {requests}",
)
def capped_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Caps tighten what was asked for and never loosen it."""
    asked = F.when(F.col("request_id") % 4 != 0, F.col("request_id") % 800)
    out = _limited(spark, sf)
    return out.select("request_id", enforce.capped_tokens(asked, F.col("obligations")).alias("max_tokens"))


@query(
    "capped_results",
    "with n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rn from {lineitem})"
    " select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from n where l_orderkey % 3 = 0 or rn <= 2",
)
def capped_results(spark: SparkSession, sf: str) -> DataFrame:
    """At most so many rows per request; a request without a limit keeps all."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = derived.table(spark, sf, "lineitem").select("l_orderkey", *order)
    limit = F.when(F.col("l_orderkey") % 3 != 0, F.lit(2))
    return enforce.capped_rows(rows, ["l_orderkey"], order, limit)


@query("dropped_results", "select l_orderkey, case when l_orderkey % 3 = 0 then 0 else greatest(count(*) - 2, 0) end as dropped from {lineitem} group by 1")
def dropped_results(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.when(F.col("l_orderkey") % 3 != 0, F.lit(2))
    return enforce.dropped_rows(derived.table(spark, sf, "lineitem"), ["l_orderkey"], limit)


_CUT = "list_max(list_filter(range(1, 402), lambda n: strlen(left(text, n)) <= cap))"


@query(
    "capped_bytes",
    f"with t as (select doc_id, text, 100 + doc_id % 300 as cap from {{documents}}) select doc_id, case when strlen(text) > cap then left(text, {_CUT}) || chr(10) || chr(10) || '[truncated by data governance policy]' else text end as text,"
    " case when strlen(text) > cap then strlen(text) - cap end as cut_bytes from t",
)
def capped_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Cut at a character boundary, marked, and counted."""
    docs = derived.table(spark, sf, "documents")
    cut = enforce.capped_bytes(F.col("text"), F.lit(100) + F.col("doc_id") % 300)
    return docs.select("doc_id", cut.alias("c")).select("doc_id", "c.text", F.col("c.cut_bytes").cast("bigint").alias("cut_bytes"))


@query(
    "watermark_text",
    "select event_id as request_id, action || case when action = 'infer' then chr(10) || chr(10) || 'marked' else '' end || case when action in ('infer', 'read') then chr(10) || chr(10) || 'twice' else '' end as text from {requests}",
)
def watermark_text(spark: SparkSession, sf: str) -> DataFrame:
    out = _limited(spark, sf)
    return out.select("request_id", enforce.watermarked(F.col("action"), F.col("obligations")).alias("text"))


@query(
    "purpose_check",
    "select event_id as request_id, case when action in ('infer', 'read') and coalesce(purpose, '') not in ('support', 'analytics') then 'the declared purpose ''' || coalesce(purpose, '') || ''' is not among the purposes this policy permits (support, analytics)' end as refusal from {requests}",
)
def purpose_check(spark: SparkSession, sf: str) -> DataFrame:
    out = _limited(spark, sf)
    declared = F.try_variant_get(F.try_element_at("context", F.lit("purpose")), "$", "string")
    return out.select("request_id", enforce.purpose_refusal(F.col("obligations"), declared).alias("refusal"))


@query(
    "merged_duties",
    "select event_id as request_id, case when action = 'infer' then 6 when action = 'read' then 4 else 1 end as duties, case action when 'infer' then 12 when 'read' then 8 else 2 end as before from {requests}",
)
def merged_duties(spark: SparkSession, sf: str) -> DataFrame:
    """Duties of two decisions together, exact duplicates once."""
    out = _limited(spark, sf)
    both = O.merged(F.col("obligations"), F.reverse("obligations"))
    return out.select("request_id", F.size(both).alias("duties"), (F.size("obligations") * 2).alias("before"))


@query(
    "principal_allow_list",
    "select event_id as request_id, case event_id % 4 when 0 then true when 1 then principal_type = 'agent' when 2 then principal_id = 'user:1' else principal_type = 'user' or principal_id = 'agent:3' end as allowed from {requests}",
)
def principal_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Whom a caller may speak for: anyone, named principals, or a prefix of them."""
    lists = [[], ["agent:*"], ["user:1"], ["user:*", "agent:3"]]
    cases = [F.array(*[F.lit(x) for x in one]).cast("array<string>") for one in lists]
    pick = F.col("request_id") % 4
    allowed = F.when(pick == 0, cases[0]).when(pick == 1, cases[1]).when(pick == 2, cases[2]).otherwise(cases[3])
    r = access_requests(spark, sf)
    return r.select("request_id", enforce.may_act_for(allowed, F.col("principal.id")).alias("allowed"))


@query(
    "tool_listing_filter",
    "select p_partkey, c_custkey from {part} p join {customer} c on c.c_custkey % 100 = p.p_partkey % 100 where c.c_mktsegment = 'MACHINERY' or (c.c_mktsegment = 'BUILDING' and p_type = 'ECONOMY')",
)
def tool_listing_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tools offered to each principal, those a decision allows."""
    tools = derived.run(spark, sf, "select p_partkey, p_type, p_partkey % 100 as share from {part}")
    principals = derived.run(spark, sf, "select c_custkey, c_mktsegment, c_custkey % 100 as share from {customer}")
    offered = tools.select("share", "p_partkey", F.struct(F.col("p_type").alias("kind")).alias("resource"))
    asking = principals.select("share", "c_custkey", F.struct(F.lit("agent").alias("type"), F.col("c_mktsegment").alias("tier")).alias("principal"))
    rules = [
        {"key": "m", "effect": "allow", "match": {"principal.tier": "MACHINERY"}},
        {"key": "b", "effect": "allow", "match": {"principal.tier": "BUILDING", "resource.kind": "ECONOMY"}},
    ]
    return policy.evaluate_pairs(asking, offered, ["share"], ["p_partkey", "c_custkey"], rules, effect="allow")


@query(
    "two_way_governance",
    "with q as (select event_id, action from {requests}) select event_id as request_id, action in ('infer', 'read', 'search') as asked, event_id % 3 <> 0 as answered,"
    " action in ('infer', 'read', 'search') and event_id % 3 <> 0 as delivered, case when action in ('infer', 'read', 'search') and event_id % 3 <> 0 then 2 else 0 end as duties from q",
)
def two_way_governance(spark: SparkSession, sf: str) -> DataFrame:
    """A request and its answer decided apart; both sets of duties bind what is delivered."""
    r = access_requests(spark, sf).withColumn("correlation_id", F.col("request_id"))
    there = policy.evaluate(r, [{"key": "q", "effect": "allow", "match": {"action": ["infer", "read", "search"]}, "obligations": [{"type": "limit", "max_tokens": 5}]}])
    back = r.withColumn("action", F.lit("return")).withColumn("env", F.struct((F.col("request_id") % 3 != 0).alias("clean")))
    answers = policy.evaluate(back, [{"key": "a", "effect": "allow", "match": {"env.clean": True}, "obligations": [{"type": "watermark", "text": "x"}]}])
    both = enforce.governed_answers(there, answers)
    return both.select(
        F.col("correlation_id").alias("request_id"),
        (F.col("request_effect") == "allow").alias("asked"),
        (F.col("answer_effect") == "allow").alias("answered"),
        "delivered",
        F.size("obligations").alias("duties"),
    )


# --------------------------------------------------------------------------- decision history


def _listed(column: str):
    return F.filter(F.split(column, ","), lambda x: x != "")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = derived.table(spark, sf, "decisions")
    return d.withColumns(
        {
            "classifications": _listed("labels_text"),
            "matched_policies": _listed("matched_text"),
            "unsupported_obligations": _listed("unsupported_text"),
        }
    ).drop("labels_text", "matched_text", "unsupported_text")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.table(spark, sf, "reports")
    return r.withColumns({"discharged": _listed("discharged_text"), "undischarged": _listed("undischarged_text")}).drop(
        "discharged_text", "undischarged_text"
    )


@query(
    "list_decisions",
    "select decision_id, effect from {decisions} where effect = 'allow' and outcome = 'refused' and determining_policy = 'p2' order by ts desc, decision_id limit 50 offset 5",
)
def list_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = outcomes.matching(decisions(spark, sf), effect="allow", policy="p2", outcome="refused")
    return outcomes.page(rows, [F.desc("ts"), F.col("decision_id")], 50, 5).select("decision_id", "effect")


@query("unreported_decisions", "select decision_id from {decisions} where effect = 'allow' and outcome is null")
def unreported_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.matching(decisions(spark, sf), outcome="unreported").select("decision_id")


@query(
    "decision_totals",
    "select count(*) as total, round(avg(latency_ms), 3) as avg_latency_ms, cast(sum(redaction_count) as bigint) as total_redactions, count(*) filter (where effect = 'allow' and outcome in ('refused', 'partial')) as permitted_but_not_enforced from {decisions}",
)
def decision_totals(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.totals(decisions(spark, sf))


@query("decisions_by_effect", "select effect, count(*) as n from {decisions} group by 1")
def decisions_by_effect(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.by_effect(decisions(spark, sf))


@query("decisions_by_outcome", "select coalesce(outcome, 'unreported') as outcome, count(*) as n from {decisions} where effect = 'allow' group by 1")
def decisions_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.by_outcome(decisions(spark, sf))


@query("decisions_by_policy", "select determining_policy as policy, count(*) as n from {decisions} where determining_policy is not null group by 1 order by n desc, policy limit 20")
def decisions_by_policy(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.by_policy(decisions(spark, sf))


@query("decisions_holding", "select decision_id from {decisions} where list_contains(string_split(labels_text, ','), 'phi.mrn') and list_contains(string_split(matched_text, ','), 'p4')")
def decisions_holding(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.holding(decisions(spark, sf), ["phi.mrn"], ["p4"]).select("decision_id")


_EDGES = ", ".join(
    f"count(*) filter (where latency_ms <= {e}) as le_{str(e).replace('.', '_')}" for e in outcomes.LATENCY_EDGES_MS
)


@query("latency_histogram", f"select effect, {_EDGES}, count(*) as le_inf from {{decisions}} group by 1")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.latency_histogram(decisions(spark, sf), ["effect"])


_REPORT_ERROR = (
    "case when outcome not in ('enforced', 'refused', 'partial') then 'unknown outcome' when outcome <> 'enforced' and trim(reason) = '' then 'needs a reason'"
    " when outcome = 'partial' and undischarged_text = '' then 'must name what was not discharged' end"
)


@query("outcome_report_check", f"select report_id, {_REPORT_ERROR} as error from {{reports}}")
def outcome_report_check(spark: SparkSession, sf: str) -> DataFrame:
    r = reports(spark, sf)
    return r.select("report_id", outcomes.report_error(r).alias("error"))


_VALID = f"v as (select * from {{reports}} where {_REPORT_ERROR} is null), f as (select *, first_value(report_id) over w as first_id, first_value(outcome) over w as first_outcome from v window w as (partition by decision_id order by reported_at, report_id))"


@query(
    "outcome_reconciliation",
    f"with {_VALID} select report_id, case when report_id = first_id then 'recorded' when outcome = first_outcome then 'repeat' else 'conflict' end as verdict, first_outcome as recorded_outcome from f",
)
def outcome_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """The first report counts, a repeat is nothing, a different one is a conflict."""
    r = reports(spark, sf)
    out = outcomes.reconcile(r.where(outcomes.report_error(r).isNull()))
    return out.select("report_id", "verdict", "recorded_outcome")


@query(
    "contradiction_correction",
    f"with {_VALID}, j as (select f.*, contains(discharged_text, 'redact') and contains(unsupported_text, 'redact') as wrong from f join {{decisions}} d using (decision_id) where report_id = first_id)"
    " select decision_id, case when wrong then 'partial' else outcome end as outcome, case when wrong then concat_ws('; ', nullif(reason, ''), 'corrected: redact was reported discharged, and this decision recorded it as handed over undischarged') else reason end as reason,"
    " case when wrong then 'watermark' else replace(discharged_text, ',', ' ') end as discharged, trim(case when wrong then 'redact ' else '' end || undischarged_text) as undischarged from j",
)
def contradiction_correction(spark: SparkSession, sf: str) -> DataFrame:
    """A claim about what the decision itself did is checked against its record."""
    out = outcomes.record_outcomes(decisions(spark, sf).drop("outcome"), reports(spark, sf)).where(F.col("outcome").isNotNull())
    return out.select(
        "decision_id",
        "outcome",
        F.col("outcome_reason").alias("reason"),
        F.array_join("discharged", " ").alias("discharged"),
        F.array_join("undischarged", " ").alias("undischarged"),
    )


# --------------------------------------------------------------------------- approvals


@query(
    "park_for_approval",
    "with recursive live as (select fingerprint, max(expires_at) as until from {tickets} where status = 'pending' group by 1),"
    " ask as (select request_fingerprint as fingerprint, decision_id, ts from {decisions} left join live on fingerprint = request_fingerprint where effect = 'require_approval' and (until is null or until <= ts)),"
    " next as materialized (select a.decision_id, arg_min(b.decision_id, (b.ts, b.decision_id)) as then_id from ask a join ask b on a.fingerprint = b.fingerprint and a.ts + interval '24' hour <= b.ts group by 1),"
    " opened as (select arg_min(decision_id, (ts, decision_id)) as decision_id from ask group by fingerprint union all select then_id from opened join next using (decision_id))"
    " select fingerprint, decision_id, 'pending' as status from opened join ask using (decision_id)",
)
def park_for_approval(spark: SparkSession, sf: str) -> DataFrame:
    """A ticket for every ask that no live one of its request covers."""
    parked = approvals.park(decisions(spark, sf).withColumnRenamed("request_fingerprint", "fingerprint"), derived.table(spark, sf, "tickets"))
    return parked.select("fingerprint", "decision_id", "status")


#: Each parked request presents the ticket of the request before it of the same kind, or none.
_OFFERS = (
    "select d.*, case when d.decision_id % 11 = 0 then d.decision_id + 1000000 when d.decision_id % 7 = 0 then null else t.approval_id end as presented_id,"
    " d.ts + interval '3' hour as used_at from {decisions} d left join {tickets} t on t.decision_id = d.decision_id - d.decision_id % 2 where d.effect = 'require_approval'"
)
_WHY = (
    "case when t.approval_id is null then 'no approval request' when t.status = 'pending' then 'the approval request is still awaiting a decision'"
    " when t.status = 'denied' then 'the approval request was denied' when t.status <> 'granted' then 'the approval request is ' || t.status"
    " when t.redeemed_at is not null then 'already redeemed by ' || coalesce(t.redeemed_by, 'an unknown caller')"
    " when t.expires_at <= o.used_at then 'expired' when t.fingerprint <> o.request_fingerprint then 'different request' end"
)


def _short(error):
    return (
        F.when(F.contains(error, F.lit("already redeemed at")), F.concat(F.lit("already redeemed by "), F.regexp_extract(error, " by (.*)$", 1)))
        .when(F.startswith(error, F.lit("the approval expired at")), F.lit("expired"))
        .when(F.contains(error, F.lit("different request")), F.lit("different request"))
        .otherwise(error)
    )


@query(
    "approval_validity",
    f"with o as ({_OFFERS}) select o.decision_id, {_WHY} as error from o left join {{tickets}} t on t.approval_id = o.presented_id where o.presented_id is not null",
)
def approval_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Why each presented ticket can or cannot be spent, first reason first."""
    offers = derived.run(spark, sf, _OFFERS).where(F.col("presented_id").isNotNull()).select(
        F.col("decision_id").alias("request"), "presented_id", "used_at", "request_fingerprint"
    )
    joined = offers.join(derived.table(spark, sf, "tickets"), F.col("presented_id") == F.col("approval_id"), "left")
    error = approvals.redemption_error(F.col("request_fingerprint"), F.col("used_at"))
    return joined.select(F.col("request").alias("decision_id"), _short(error).alias("error"))


@query(
    "redeem_approvals",
    f"with o as ({_OFFERS}), j as (select o.decision_id, o.presented_id, o.used_at, {_WHY} as why from o left join {{tickets}} t on t.approval_id = o.presented_id),"
    " w as (select *, case when presented_id is not null and why is null then row_number() over (partition by presented_id, why is null order by used_at, decision_id) end as turn from j)"
    " select decision_id, case when turn = 1 then 'allow' else 'require_approval' end as effect, coalesce(turn = 1, false) as redeemed, case when turn = 1 then 2 else 0 end as duties from w",
)
def redeem_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """A valid ticket turns one parked request into an allow that carries every duty along."""
    rules = [
        {"key": "base", "effect": "allow", "priority": 1, "obligations": [{"type": "watermark", "text": "w"}, {"type": "limit", "max_rows": 9}]},
        {"key": "never", "effect": "deny", "priority": 9},
    ]
    offers = derived.run(spark, sf, _OFFERS)
    parked = offers.withColumns(
        {"matched_policies": _listed("matched_text"), "obligations": F.array().cast(O.OBLIGATIONS), "reason": F.lit("parked")}
    )
    out = approvals.redeem(parked, derived.table(spark, sf, "tickets"), rules, at="used_at")
    return out.select("decision_id", "effect", "redeemed", F.size("obligations").alias("duties"))


_VOTES = "select event_id as approval_id, event_id % 2 = 0 as grant, concat('user:', cast(user_id as string)) as voter, 'ok' as note, case when event_id % 3 = 0 then ts + interval '30' hour else ts + interval '2' hour end as voted_at from {events} where event_type = 'signup' and event_id % 4 <> 0 union all select event_id, false, 'user:late', 'no', ts + interval '40' hour from {events} where event_type = 'signup'"


@query(
    "resolve_approvals",
    f"with v as ({_VOTES.replace(' as grant', ' as granted')}), f as (select approval_id, arg_min(granted, (voted_at, voter)) as granted, arg_min(voter, (voted_at, voter)) as voter, min(voted_at) as voted_at from v group by 1)"
    " select approval_id, case when status <> 'pending' or f.approval_id is null then status when expires_at <= f.voted_at then 'expired' when granted then 'granted' else 'denied' end as status,"
    " case when status = 'pending' and expires_at > f.voted_at then voter end as decided_by from {tickets} t left join f using (approval_id)",
)
def resolve_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """The first vote settles a pending ticket, unless it comes too late."""
    votes = derived.run(spark, sf, _VOTES.replace(" as grant", " as granted")).withColumnRenamed("granted", "grant")
    out = approvals.resolve(derived.table(spark, sf, "tickets"), votes)
    return out.select("approval_id", "status", "decided_by")


@query(
    "list_approvals",
    "select approval_id, action, principal_id, status = 'granted' and redeemed_at is null as redeemable from {tickets} join {decisions} using (decision_id) where status = 'granted' order by created_at desc, approval_id limit 50",
)
def list_approvals(spark: SparkSession, sf: str) -> DataFrame:
    page = approvals.listing(derived.table(spark, sf, "tickets"), decisions(spark, sf), "granted")
    return page.select("approval_id", "action", "principal_id", "redeemable")


@query("redeemable_approvals", "select approval_id, status = 'granted' and redeemed_at is null as redeemable from {tickets}")
def redeemable_approvals(spark: SparkSession, sf: str) -> DataFrame:
    t = derived.table(spark, sf, "tickets")
    return t.select("approval_id", approvals.redeemable(F.col("status"), F.col("redeemed_at")).alias("redeemable"))


@query("expired_approvals", "select approval_id from {tickets} where status = 'pending' and expires_at <= timestamp '2024-01-15'")
def expired_approvals(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return approvals.expired(derived.table(spark, sf, "tickets"), now).select("approval_id")
