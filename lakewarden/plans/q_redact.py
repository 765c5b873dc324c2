"""Queries over redaction strategies, rewriting, tokens and scrubbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import crypto
from lakewarden.operators import obligations as O
from lakewarden.operators import redact, scan
from lakewarden.plans import derived, oracle
from lakewarden.plans.registry import query

KEY = b"check-key-redaction"
TOKEN_KEY = b"check-key-tokens-0123456789abcdef"
OLD_KEY = b"check-key-tokens-retired"

#: One rule per strategy, then a family rule; dates, addresses and the like stay untouched.
RULEBOOK = [
    {"type": "redact", "labels": ["pii.ssn", "secret"], "strategy": "mask"},
    {"type": "redact", "labels": ["pci.card_number"], "strategy": "partial", "keep_last": 4},
    {"type": "limit", "max_rows": 5},
    {"type": "redact", "labels": ["pii.email", "pii.phone"], "strategy": "hash", "hash_length": 12},
    {"type": "redact", "labels": ["phi.npi"], "strategy": "drop"},
    {"type": "redact", "labels": ["pci", "pii.ip_address"], "strategy": "synthetic"},
]
SCAN = "with " + oracle.scan_ctes()
MASKED = "'[REDACTED:' || label || ']'"


def _message(prefix: str = "") -> str:
    return f"encode('{prefix}' || label || ':' || value)"


def hash_sql(length: int) -> str:
    return f"'<' || label || ':' || left({oracle.hmac_sql(KEY, _message())}, {length}) || '>'"


def partial_sql(keep: int) -> str:
    kept = f"least({keep}, length(value))"
    head = f"regexp_replace(left(value, length(value) - {kept}), '[\\p{{{{L}}}}\\p{{{{N}}}}]', '*', 'g')"
    return f"case when {kept} = 0 then repeat('*', length(value)) else {head} || right(value, {kept}) end"


def synthetic_sql() -> str:
    digest = oracle.hmac_sql(KEY, _message("synth:"))
    d = (
        f"array_to_string(list_transform(range(32), lambda i: cast(cast('0x' || substr({digest}, cast(2 * i + 1 as bigint), 2) as int) % 10 as varchar)), '')"
    )
    shaped = (
        "array_to_string(list_transform(range(length(value)), lambda i: case when regexp_matches(substr(value, i + 1, 1),"
        " '^\\p{{N}}$') then substr(d, (i % 32) + 1, 1) when regexp_matches(substr(value, i + 1, 1), '^\\p{{L}}$') then 'x'"
        " else substr(value, i + 1, 1) end), '')"
    )
    return d, (
        "case label when 'pii.email' then 'user' || left(d, 6) || '@example.invalid' when 'pii.phone' then '+1555' || left(d, 7)"
        " when 'pii.ssn' then '900-' || substr(d, 1, 2) || '-' || substr(d, 3, 4) when 'pci.card_number' then '4000' || left(d, 12)"
        f" else {shaped} end"
    )


_DIGITS, _SHAPE = synthetic_sql()
#: Findings with the strategy the rulebook picks and the text that replaces each.
EDITS = (
    SCAN
    + f""", digested as (select *, {_DIGITS} as d from kept),
ruled as (select *, case when label = 'pii.ssn' or starts_with(label, 'secret.') then 'mask'
  when label = 'pci.card_number' then 'partial' when label in ('pii.email', 'pii.phone') then 'hash'
  when label = 'phi.npi' then 'drop' when starts_with(label, 'pci.') or label = 'pii.ip_address' then 'synthetic' end as strategy from digested),
edits as (select *, case strategy when 'mask' then {MASKED} when 'partial' then {partial_sql(4).replace('{{{{', '{{').replace('}}}}', '}}')}
  when 'hash' then {hash_sql(12)} when 'drop' then '' when 'synthetic' then {_SHAPE} end as replacement from ruled)"""
)


def _values(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.scan(derived.table(spark, sf, "corpus"), "text", ["id"])
    return found.select("id", F.col("start").alias("start_at"), "label", "value")


def _rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return redact.redact_text(derived.table(spark, sf, "corpus"), "text", O.literal(RULEBOOK), key=KEY)


_AT = "select id, cast(s as int) as start_at, "


@query("mask_values", SCAN + _AT + f"{MASKED} as shown from kept".replace("select id", " select id"))
def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf).select("id", "start_at", redact.mask(F.col("label")).alias("shown"))


@query(
    "partial_values",
    SCAN + " " + _AT + f"{partial_sql(4)} as shown, {partial_sql(0)} as none_kept, {partial_sql(500)} as all_kept from kept".replace("{{{{", "{{").replace("}}}}", "}}"),
)
def partial_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return _values(spark, sf).select(
        "id",
        "start_at",
        redact.partial(v, F.lit(4)).alias("shown"),
        redact.partial(v, F.lit(0)).alias("none_kept"),
        redact.partial(v, F.lit(500)).alias("all_kept"),
    )


@query("hash_values", SCAN + " " + _AT + f"{hash_sql(16)} as shown, {hash_sql(4)} as shortest, {hash_sql(64)} as longest from kept")
def hash_values(spark: SparkSession, sf: str) -> DataFrame:
    def shown(n: int):
        return redact.hashed(F.col("label"), F.col("value"), F.lit(n), KEY)

    return _values(spark, sf).select(
        "id", "start_at", shown(16).alias("shown"), shown(1).alias("shortest"), shown(900).alias("longest")
    )


@query("synthetic_values", SCAN + f", g as (select *, {_DIGITS} as d from kept) " + _AT + f"{_SHAPE} as shown from g")
def synthetic_values(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf).select(
        "id", "start_at", redact.synthetic(F.col("label"), F.col("value"), KEY).alias("shown")
    )


@query("drop_values", "with " + oracle.scan_ctes() + ", cut as (select id, sum(length(value)) as lost from kept group by 1)"
       " select c.id, cast(length(text) - coalesce(lost, 0) as int) as chars_left from {corpus} c left join cut using (id)")
def drop_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding replaced by nothing."""
    rule = O.literal([{"type": "redact", "labels": ["*"], "strategy": "drop"}])
    out = redact.redact_text(derived.table(spark, sf, "corpus"), "text", rule)
    return out.select("id", F.length("redacted").alias("chars_left"))


@query("redaction_rule_choice", EDITS + " select id, cast(s as int) as start_at, label, coalesce(strategy, 'unhandled') as strategy from edits")
def redaction_rule_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule covering each finding."""
    rules = O.literal(RULEBOOK)
    return _values(spark, sf).select(
        "id",
        "start_at",
        "label",
        F.coalesce(redact.rule_for(rules, F.col("label"))["strategy"], F.lit("unhandled")).alias("strategy"),
    )


#: Text rebuilt from the right, so offsets stay those of the original.
REBUILT = (
    EDITS
    + """, steps as (select id, list({{'t': '', 's': s, 'e': e, 'r': replacement}} order by s desc) as es from edits where strategy is not null group by id),
texts as (select c.id, case when es is null then text else list_reduce(list_prepend({{'t': text, 's': 0::bigint, 'e': 0::bigint, 'r': ''}}, es),
  lambda a, x: {{'t': substr(a.t, 1, x.s) || x.r || substr(a.t, x.e + 1), 's': 0::bigint, 'e': 0::bigint, 'r': ''}}).t end as redacted
  from {corpus} c left join steps using (id))"""
)


@query("redact_text", REBUILT + " select id, redacted from texts")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts rewritten under a rulebook of five strategies."""
    return _rewritten(spark, sf).select("id", "redacted")


@query(
    "redaction_records",
    EDITS + " select id, cast(row_number() over (partition by id order by s) - 1 as int) as position, label, strategy,"
    " cast(s as int) as start_at, cast(e as int) as end_at, replacement from edits where strategy is not null",
)
def redaction_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = redact.edit_records(_rewritten(spark, sf), ["id"])
    return rows.withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query(
    "redaction_summary",
    EDITS + ", by_s as (select id, strategy, count(*) as n from edits where strategy is not null group by 1, 2),"
    " st as (select id, string_agg(strategy || '=' || n, ' ' order by strategy) as by_strategy, sum(n) as n from by_s group by 1),"
    " lb as (select id, string_agg(distinct case when strategy is not null then label end, ',' order by case when strategy is not null then label end) as done,"
    " string_agg(distinct case when strategy is null then label end, ',' order by case when strategy is null then label end) as left_over from edits group by 1)"
    " select c.id, cast(coalesce(n, 0) as int) as redaction_count, coalesce(by_strategy, '') as by_strategy, coalesce(done, '') as labels_redacted,"
    " coalesce(left_over, '') as unhandled_labels from {corpus} c left join st using (id) left join lb using (id)",
)
def redaction_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = _rewritten(spark, sf).select("id", redact.summary(F.col("edits"), F.col("unhandled")).alias("s"))
    pairs = F.transform(
        F.array_sort(F.map_keys("s.by_strategy")),
        lambda k: F.concat(k, F.lit("="), F.col("s.by_strategy")[k].cast("string")),
    )
    return out.select(
        "id",
        "s.redaction_count",
        F.array_join(pairs, " ").alias("by_strategy"),
        F.array_join("s.labels_redacted", ",").alias("labels_redacted"),
        F.array_join("s.unhandled_labels", ",").alias("unhandled_labels"),
    )


@query(
    "residual_labels",
    EDITS + ", r as (select id, string_agg(distinct label, ',' order by label) as labels from edits where strategy is null group by 1)"
    " select c.id, coalesce(labels, '') as residual from {corpus} c left join r using (id)",
)
def residual_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What was found and no rule covers."""
    found = scan.with_findings(derived.table(spark, sf, "corpus"), "text").withColumn("rules", O.literal(RULEBOOK))
    return found.select(
        "id", F.array_join(redact.residual_labels(F.col("findings"), F.col("rules")), ",").alias("residual")
    )


_LEAF_RULES = [
    {"type": "redact", "labels": ["pii.ssn", "pci"], "strategy": "mask"},
    {"type": "redact", "labels": ["pii.email"], "strategy": "drop"},
]


def _leaf_text(path: str) -> str:
    return f"coalesce((select g.redacted from governed g where g.id = j.row_id || '{path}'), '')"


@query(
    "redact_structured",
    "with " + oracle.scan_ctes(
        """(select row_id || p as id, text, hint from (
  select row_id, '/ssn' as p, json_extract_string(body, '$.ssn') as text, 'ssn' as hint from {sensitive_json}
  union all select row_id, '/contact/email', json_extract_string(body, '$.contact.email'), 'email' from {sensitive_json}
  union all select row_id, '/contact/a~1b', json_extract_string(body, '$.contact."a/b"'), 'a/b' from {sensitive_json}
  union all select row_id, '/cards/0', json_extract_string(body, '$.cards[0]'), 'cards' from {sensitive_json}) t)"""
    )
    + """, edits as (select id, s, e, case when label in ('pii.ssn', 'pci.card_number') then '[REDACTED:' || label || ']' when label = 'pii.email' then '' end as r
  from kept where label in ('pii.ssn', 'pci.card_number', 'pii.email')),
srcs as (select row_id || p as id, text from (
  select row_id, '/ssn' as p, json_extract_string(body, '$.ssn') as text from {sensitive_json}
  union all select row_id, '/contact/email', json_extract_string(body, '$.contact.email') from {sensitive_json}
  union all select row_id, '/contact/a~1b', json_extract_string(body, '$.contact."a/b"') from {sensitive_json}
  union all select row_id, '/cards/0', json_extract_string(body, '$.cards[0]') from {sensitive_json}) t),
steps as (select id, list({{'t': '', 's': s, 'e': e, 'r': r}} order by s desc) as es from edits group by id),
governed as (select id, case when es is null then text else list_reduce(list_prepend({{'t': text, 's': 0::bigint, 'e': 0::bigint, 'r': ''}}, es),
  lambda a, x: {{'t': substr(a.t, 1, x.s) || x.r || substr(a.t, x.e + 1), 's': 0::bigint, 'e': 0::bigint, 'r': ''}}).t end as redacted from srcs left join steps using (id))
select j.row_id, g1.redacted as ssn, g2.redacted as email, g3.redacted as call, g4.redacted as card, 'none' as second, j.row_id as n, true as ok
from {sensitive_json} j join governed g1 on g1.id = j.row_id || '/ssn' join governed g2 on g2.id = j.row_id || '/contact/email'
join governed g3 on g3.id = j.row_id || '/contact/a~1b' join governed g4 on g4.id = j.row_id || '/cards/0'""",
)
def redact_structured(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text rewritten leaf by leaf; numbers, flags and structure survive."""
    out = redact.redact_structured(
        derived.table(spark, sf, "sensitive_json"), "body", ["row_id"], O.literal(_LEAF_RULES)
    )
    shape = "ssn string, contact struct<email:string,`a/b`:string>, cards array<string>, n bigint, ok boolean"
    j = out.select("row_id", F.from_json("body", shape).alias("j"))
    return j.select(
        "row_id",
        "j.ssn",
        "j.contact.email",
        F.col("j.contact").getField("a/b").alias("call"),
        F.col("j.cards")[0].alias("card"),
        F.col("j.cards")[1].alias("second"),
        "j.n",
        "j.ok",
    )


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """JSON 1 to 40 objects deep with an address at the bottom."""
    return derived.run(
        spark,
        sf,
        "select c_custkey, cast(1 + c_custkey % 40 as int) as levels, concat(repeat('{{\"a\":', cast(1 + c_custkey % 40 as int)), '\"user', cast(c_custkey as string),"
        " '@mail.example.com\"', repeat('}}', cast(1 + c_custkey % 40 as int))) as body from {customer}",
    )


@query("redact_deep", "select c_custkey, 1 + c_custkey % 40 > 24 as truncated, 1 + c_custkey % 40 <= 24 as masked, false as leaked from {customer}")
def redact_deep(spark: SparkSession, sf: str) -> DataFrame:
    """What lies below the depth that is scanned is withheld, and the row says so."""
    rule = O.literal([{"type": "redact", "labels": ["pii.email"], "strategy": "mask"}])
    out = redact.redact_structured(_nested(spark, sf), "body", ["c_custkey"], rule)
    return out.select(
        "c_custkey",
        "truncated",
        F.contains("body", F.lit("[REDACTED:pii.email]")).alias("masked"),
        F.contains("body", F.lit("@mail")).alias("leaked"),
    )


@query("scan_deep", "select c_custkey, 1 + c_custkey % 40 > 24 as truncated, case when 1 + c_custkey % 40 <= 24 then 'pii.email' end as label from {customer}")
def scan_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A finding per document, or the report that its bottom was not looked at."""
    return scan.scan_structured(_nested(spark, sf), "body", ["c_custkey"]).select("c_custkey", "truncated", "label")


@query(
    "redact_typed_columns",
    "select c_custkey, regexp_replace(c_name, '#.*', '#') || case when 'x' = 'x' then '' end as label_part, c_acctbal from {customer}",
)
def redact_typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Typed nested columns rewritten through their schema, other types untouched."""
    from lakewarden.plans.q_scan import CUSTOMER_NUMBER

    rows = derived.table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.array("c_name", "c_mktsegment").alias("names"), "c_acctbal").alias("row")
    )
    rule = O.literal([{"type": "redact", "labels": ["confidential"], "strategy": "drop"}])
    out = redact.redact_structured(rows, "row", ["c_custkey"], rule, rules=[CUSTOMER_NUMBER])
    return out.select("c_custkey", F.col("row.names")[0].alias("label_part"), F.col("row.c_acctbal").alias("c_acctbal"))


# --------------------------------------------------------------------------- tokens

_TOKEN_ROWS = "select c_custkey, case when c_custkey % 2 = 0 then 'pii.name' else 'pii.email' end as label, c_name || ' ' || c_mktsegment as value from {customer}"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.run(spark, sf, _TOKEN_ROWS)
    return rows.withColumn("token", crypto.token(F.col("label"), F.col("value"), TOKEN_KEY))


@query(
    "token_round_trip",
    f"select c_custkey, value as recovered, true as shaped, true as repeatable, 37 + 4 * length(value) // 3 > 0 as sized from ({_TOKEN_ROWS}) t",
)
def token_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every token reverses to its value and is the same when minted again."""
    t = _tokens(spark, sf)
    again = crypto.token_matches(F.col("label"), F.col("value"), F.col("token"), TOKEN_KEY)
    return t.select(
        "c_custkey",
        crypto.detoken(F.col("token"), TOKEN_KEY).alias("recovered"),
        crypto.looks_like_token(F.col("token")).alias("shaped"),
        again.alias("repeatable"),
        (F.length("token") > F.length("value")).alias("sized"),
    )


@query(
    "detokenize",
    f"select c_custkey, case when c_custkey % 5 in (0, 1) then value end as recovered from ({_TOKEN_ROWS}) t",
)
def detokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Current and retired keys are tried; foreign, damaged and shapeless tokens give null."""
    rows = derived.run(spark, sf, _TOKEN_ROWS)
    kind = F.col("c_custkey") % 5
    new = crypto.token(F.col("label"), F.col("value"), TOKEN_KEY)
    token = (
        F.when(kind == 0, new)
        .when(kind == 1, crypto.token(F.col("label"), F.col("value"), OLD_KEY))
        .when(kind == 2, crypto.token(F.col("label"), F.col("value"), b"someone else's key"))
        .when(kind == 3, F.concat(F.left(new, F.length(new) - 8), F.lit("AAAAAAAA")))
        .otherwise(F.col("value"))
    )
    return rows.select("c_custkey", crypto.detoken(token, TOKEN_KEY, [OLD_KEY]).alias("recovered"))


@query(
    "verify_token",
    f"select c_custkey, c_custkey % 3 = 0 as matches from ({_TOKEN_ROWS}) t",
)
def verify_token(spark: SparkSession, sf: str) -> DataFrame:
    """Right value and label confirm a token; a wrong value or label does not."""
    kind = F.col("c_custkey") % 3
    value = F.when(kind == 1, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    label = F.when(kind == 2, F.lit("pii.phone")).otherwise(F.col("label"))
    return _tokens(spark, sf).select("c_custkey", crypto.token_matches(label, value, F.col("token"), TOKEN_KEY).alias("matches"))


@query(
    "token_shape",
    f"select c_custkey, case c_custkey % 4 when 0 then true else false end as shaped from ({_TOKEN_ROWS}) t",
)
def token_shape(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    text = (
        F.when(kind == 0, F.col("token"))
        .when(kind == 1, F.left("token", F.lit(20)))
        .when(kind == 2, F.concat(F.lit("x"), F.col("token")))
        .otherwise(F.col("value"))
    )
    return _tokens(spark, sf).select("c_custkey", crypto.looks_like_token(text).alias("shaped"))


@query(
    "detokenize_report",
    "with t as (select c_custkey, cast(floor(c_custkey / 60) as bigint) as request_id, cast(floor(c_custkey / 60) as bigint) % 3 as m from {customer}),"
    " k as (select *, c_custkey % 60 < case when m = 0 then 60 else 45 end as used from t)"
    " select request_id, count(*) as requested, case when m = 0 then 'too many tokens' when m = 1 then 'justification too short' else '' end as refused,"
    " cast(case when m = 2 then count_if(c_custkey % 4 <> 3) end as bigint) as recovered, case when m = 2 then count(*) end as digests"
    " from k where used group by request_id, m having count(*) > 50 or m <> 0",
)
def detokenize_report(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of many tokens: checked, recovered, and digested for the record."""
    t = _tokens(spark, sf).withColumn("request_id", F.floor(F.col("c_custkey") / 60))
    m = F.col("request_id") % 3
    t = t.where(F.col("c_custkey") % 60 < F.when(m == 0, 60).otherwise(45))
    shown = F.when(F.col("c_custkey") % 4 == 3, F.concat(F.col("token"), F.lit("x"))).otherwise(F.col("token"))
    why = F.when(m == 1, F.lit("no")).otherwise(F.lit("incident 42"))
    out = redact_report(t.select("request_id", shown.alias("token"), why.alias("justification")))
    full = (F.col("request_id") % 3 != 0) | (F.col("requested") > 50)
    return out.where(full).select(
        "request_id", "requested", "refused", "recovered", F.when(F.col("refused") == "", F.size("digests")).cast("bigint").alias("digests")
    )


def redact_report(tokens: DataFrame) -> DataFrame:
    from lakewarden.operators.tokens import reversal_report

    return reversal_report(tokens, TOKEN_KEY, audit_key=KEY)


# --------------------------------------------------------------------------- scrubbing


@query(
    "context_scrub",
    "select event_id, '[dropped]' as authorization, case when event_id % 2 = 0 then left(repeat(event_type || ' ', 200), 512) || '...' else event_type end as note from {events}",
)
def context_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Credential keys dropped in any case, long strings cut."""
    long = F.repeat(F.concat("event_type", F.lit(" ")), F.lit(200))
    note = F.when(F.col("event_id") % 2 == 0, long).otherwise(F.col("event_type"))
    rows = derived.table(spark, sf, "events").select(
        "event_id", F.create_map(F.lit("Authorization"), F.lit("Bearer x"), F.lit("note"), note).alias("c")
    )
    clean = rows.select("event_id", redact.scrub_context(F.col("c")).alias("c"))
    return clean.select("event_id", F.col("c")["Authorization"].alias("authorization"), F.col("c")["note"].alias("note"))


@query(
    "keyed_digest",
    "select doc_id, " + oracle.hmac_sql(KEY, "encode(text)") + " as digest from {documents}",
)
def keyed_digest(spark: SparkSession, sf: str) -> DataFrame:
    docs = derived.table(spark, sf, "documents")
    return docs.select("doc_id", crypto.content_digest(F.col("text"), KEY).alias("digest"))


