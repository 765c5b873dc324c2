"""Test tables computed from the given ones, as SQL that Spark and DuckDB both run.

The given tables hold few kinds of sensitive value and no policies, catalog or requests, so
these derive them row by row from keys: every result grows with the table it comes from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

_V = "cast(floor(c_custkey / 28) as bigint) % 4"
#: First and third variants are well formed; the first two carry a supporting word.
_GOOD = f"({_V}) % 2 = 0"
_WORD = f"({_V}) < 2"
_HEX = "md5(cast(c_custkey as string))"
_HEX2 = "md5(concat('b', cast(c_custkey as string)))"


def _pick(values: list[str]) -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case cast(floor(c_custkey / 112) as bigint) % {len(values)} {cases} end)"


_CARDS = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4111 1111 1111 1111", "3530-1113-3330-0000"]
_BAD_CARDS = ["4111111111111112", "5500005555555550", "340000000000001", "9999000000000000", "1111111111111111", "4111 1111 1111 1113"]
_IBANS = ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606"]
_BAD_IBANS = ["DE88370400440532013000", "GB81WEST12345698765432", "DE87 3704 0044 0532 0130 00", "FR1320041010050500013M02606"]
_NPIS = ["1234567893", "1245319599", "1679576722", "1003000126"]
_BAD_NPIS = ["1234567890", "1245319590", "1679576720", "1003000120"]
_N3 = "cast(100 + c_custkey % 500 as string)"
_N2 = "cast(10 + c_custkey % 80 as string)"
_N4 = "cast(1000 + c_custkey % 8999 as string)"
_N9 = "cast(200000000 + c_custkey * 7919 as string)"


def _either(good: str, bad: str) -> str:
    return f"(case when {_GOOD} then {good} else {bad} end)"


def _word(word: str, plain: str = "value") -> str:
    return f"(case when {_WORD} then '{word}' else '{plain}' end)"


_SSN_AREA = f"(case when {_GOOD} then {_N3} else '666' end)"
_TEMPLATES = [
    f"concat({_word('email me at', 'write')}, ' user', cast(c_custkey as string), '@', {_either(repr('mail.example.com'), repr('localhost'))}, ' soon')",
    f"concat({_word('call')}, ' +1 (743) 555-', {_N4}, ' or 212-555-', {_N4}, '-x')",
    f"concat({_word('ssn')}, ' ', {_SSN_AREA}, '-', {_N2}, '-', {_N4}, ' on file')",
    f"concat({_word('taxpayer', 'order')}, ' ', {_SSN_AREA}, {_N2}, {_N4}, ' filed')",
    f"concat({_word('card')}, ' ', {_either(_pick(_CARDS), _pick(_BAD_CARDS))}, ', exp')",
    f"concat({_word('iban')}, ' ', {_either(_pick(_IBANS), _pick(_BAD_IBANS))}, '.')",
    f"concat({_word('remote host', 'seen')}, ' ', {_either(repr('85.'), repr('127.'))}, cast(c_custkey % 256 as string), '.17.4, then')",
    f"concat({_word('device', 'tag')}, ' 0a:1B:2c:3D:4e:', {_either('substr(' + _HEX + ', 1, 2)', repr('zz'))}, ' up')",
    f"concat({_word('born', 'dated')}, ' ', {_either(repr('19'), repr('18'))}, cast(50 + c_custkey % 50 as string), '-0', cast(1 + c_custkey % 9 as string), '-1', cast(c_custkey % 10 as string), '.')",
    f"concat({_word('residence', 'at')}, ' ', cast(1 + c_custkey % 9999 as string), ' Old Mill ', {_either(repr('Road'), repr('Block'))}, ', north')",
    f"concat({_word('passport')}, ' X', {_N9}, ' shown')",
    f"concat({_word('driver', 'part')}, ' D', {_either(repr('-'), repr('_'))}, {_N9}, ' shown')",
    f"concat({_word('mrn', 'lot')}, ' MR', {_N9}, ' seen')",
    f"concat({_word('npi')}, ' ', {_either(_pick(_NPIS), _pick(_BAD_NPIS))}, ' seen')",
    f"concat({_word('diagnosis', 'room')}, ' ', {_either(repr('E'), repr('U'))}, {_N2}, '.', cast(c_custkey % 10 as string), ' noted')",
    f"concat('-----BEGIN ', {_either(repr('RSA '), repr('PUBLIC '))}, 'PRIVATE KEY-----', ' x')",
    f"concat('id ', {_either(repr('AKIA'), repr('AKIB'))}, upper(substr({_HEX}, 1, 16)), ' in use')",
    f"concat('aws_secret_access_key = \"', {_HEX}, {_either('substr(' + _HEX2 + ', 1, 8)', repr('~'))}, '\"')",
    f"concat('g ', {_either(repr('AIza'), repr('AIzb'))}, {_HEX}, 'x-_', ' end')",
    f"concat('t ', {_either(repr('ghp_'), repr('ghx_'))}, {_HEX}, substr({_HEX2}, 1, 8), ' end')",
    f"concat('s ', {_either(repr('xoxb-'), repr('xoxz-'))}, {_HEX}, ' end')",
    f"concat('p sk_', {_either(repr('live_'), repr('fake_'))}, {_HEX}, ' end')",
    f"concat('a sk-ant-api03-', {_either(_HEX, repr('short'))}, ' end')",
    f"concat('o sk-', {_either('concat(' + repr('proj-') + ', ' + _HEX + ')', repr('short'))}, ' end')",
    f"concat('j eyJ', {_HEX}, '.', {_either(_HEX2, repr('abc'))}, '.', {_HEX}, ' end')",
    f"concat('u postgres://app:', {_HEX}, {_either(repr('@'), repr(' '))}, 'db.internal:5432/x end')",
    f"concat('api_key: ', {_either(_HEX, repr('aaaaaaaaaaaaaaaaaaaaaaaa'))}, ' end')",
    f"concat('password: ', {_either('substr(' + _HEX + ', 1, 10)', repr('changeme'))}, ' end')",
]
_TEXT = "case c_custkey % 28 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TEMPLATES)) + " end"

_NATION_URN = "concat('pg://', lower(r_name), '.', lower(n_name))"

DERIVED: dict[str, str] = {
    "sensitive_text": f"select c_custkey as row_id, c_custkey % 28 as kind, {_TEXT} as text from {{customer}}",
    # Everything that is scanned: the documents and the templated rows.
    "corpus": """
        select concat('d', cast(doc_id as string)) as id, text from {documents}
        union all
        select concat('s', cast(row_id as string)) as id, text from {sensitive_text}""",
    "sensitive_json": f"""
        select c_custkey as row_id,
          concat('{{{{"ssn":"', {_SSN_AREA}, {_N2}, {_N4}, '","contact":{{{{"email":"u', cast(c_custkey as string),
            '@mail.example.com","a/b":"call 212-555-', {_N4}, '"}}}},"cards":["', {_pick(_CARDS)}, '","none"],"n":',
            cast(c_custkey as string), ',"ok":true}}}}') as body
        from {{customer}}""",
    # Free-form attributes: missing, null, scalar and list values of every kind.
    "subjects": """
        select c_custkey, concat('{{"id":', cast(c_custkey as string),
          case c_custkey % 5 when 0 then '' when 1 then ',"tier":null' when 2 then ',"tier":"low"'
            when 3 then ',"tier":"low.restricted"' else ',"tier":["medium","pii.email",7,true]' end,
          ',"score":', cast(c_custkey % 100 as string),
          case c_custkey % 4 when 0 then '' when 1 then ',"load":[1,50,"9"]' when 2 then ',"load":"12"' else ',"load":true' end,
          case c_custkey % 3 when 0 then ',"tags":[]' when 1 then concat(',"tags":["', lower(c_mktsegment), '","phi.mrn"]') else '' end,
          ',"deep":{{"a":{{"b":"x', cast(c_nationkey as string), '"}},"l":["p","q","', lower(c_mktsegment), '"]}}',
          ',"path":"pg://', lower(c_mktsegment), '/t', cast(c_nationkey as string), '"}}') as body
        from {customer}""",
    "principals": """
        select case c_custkey % 3 when 0 then concat('agent:', cast(c_custkey as string))
                 when 1 then concat('user:', cast(c_custkey as string))
                 else concat('service:', cast(c_custkey as string)) end as external_id,
          case c_custkey % 3 when 0 then 'agent' when 1 then 'user' else 'service' end as type,
          c_name as display_name,
          case c_mktsegment when 'MACHINERY' then 'high' when 'BUILDING' then 'medium' when 'AUTOMOBILE' then 'low'
            when 'HOUSEHOLD' then 'untrusted' else 'unknown' end as trust_tier,
          concat('team', cast(c_nationkey as string)) as team,
          c_custkey % 11 = 0 as disabled
        from {customer} where c_custkey % 7 <> 0""",
    "assets": f"""
        select {_NATION_URN} as urn, n_name as name, 'table' as kind,
          concat('owner', cast(n_regionkey as string)) as owner, concat('Rows of ', n_name) as description,
          case when n_nationkey % 2 = 0 then 'eu' else 'us' end as zone, cast(null as string) as tier,
          cast(null as bigint) as rank, true as routable, cast(null as string) as alias
        from {{nation}} join {{region}} on n_regionkey = r_regionkey
        union all
        select concat('pg://', lower(r_name), '.*'), r_name, 'table', 'owner0', 'A whole region',
          'global', case when r_regionkey % 2 = 0 then 'gold' else 'silver' end, cast(null as bigint), true, cast(null as string)
        from {{region}}
        union all
        select concat('pg://', lower(r_name), '.nation_?'), r_name, 'table', 'owner0', 'Short names',
          cast(null as string), 'bronze', cast(null as bigint), true, cast(null as string)
        from {{region}}
        union all
        select concat('s3://', lower(p_type), '/', cast(p_partkey as string)), p_name, 'object_store', p_brand, p_type,
          'us', cast(null as string), cast(null as bigint), true, cast(null as string)
        from {{part}}
        union all
        select concat('model://vendor', cast(s_nationkey as string), '/m', cast(s_suppkey as string)), s_name, 'model',
          'ml', 'A model', case s_suppkey % 3 when 0 then 'eu' when 1 then 'us' else null end,
          case when s_suppkey % 2 = 0 then 'on_prem' else 'saas' end,
          case when s_suppkey % 4 = 0 then null else s_suppkey % 10 end, s_suppkey % 5 <> 0,
          concat('line', cast(s_suppkey % 6 as string))
        from {{supplier}}""",
    "asset_labels": f"""
        select {_NATION_URN} as urn, 'pii.email' as label, 'scan' as source, 0.82 as confidence
        from {{nation}} join {{region}} on n_regionkey = r_regionkey
        union all
        select {_NATION_URN}, 'pii.email', 'manual', cast(0.4 as double)
        from {{nation}} join {{region}} on n_regionkey = r_regionkey where n_nationkey % 3 = 0
        union all
        select {_NATION_URN}, 'phi.mrn', 'imported', cast(0.9 as double)
        from {{nation}} join {{region}} on n_regionkey = r_regionkey where n_nationkey % 4 = 1
        union all
        select concat('pg://', lower(r_name), '.*'), 'confidential.internal', 'manual', cast(1.0 as double) from {{region}}
        union all
        select concat('pg://', lower(r_name), '.nation_?'), 'pii.email', 'manual', cast(0.7 as double) from {{region}}
        union all
        select concat('pg://', lower(r_name), '.*'), 'pci.card_number', 'scan', cast(0.66 as double) from {{region}} where r_regionkey % 2 = 1
        union all
        select concat('s3://', lower(p_type), '/', cast(p_partkey as string)), 'public.open', 'manual', cast(1.0 as double)
        from {{part}} where p_partkey % 2 = 0
        union all
        select concat('s3://', lower(p_type), '/', cast(p_partkey as string)), 'pii.phone', 'scan', cast(0.55 as double) + (p_partkey % 4) * 0.1
        from {{part}} where p_partkey % 3 = 0""",
    # Patterns that begin, end or both with a wildcard, some with a class, and one that covers everything.
    "globs": """
        select concat('*/', cast(p_partkey as string)) as urn from {part}
        union
        select concat('*', lower(split_part(p_type, ' ', 3)), '/*', substr(cast(p_partkey as string), 1, 2), '*') from {part}
        union
        select concat('?3://*', lower(split_part(p_type, ' ', 2)), ' *[0-4]') from {part}
        union
        select concat('*vendor', cast(s_nationkey as string), '/*') from {supplier}
        union
        select concat('*.', lower(n_name)) from {nation}
        union
        select concat('pg://*', substr(lower(r_name), 1, 3), '*.nation_?') from {region}
        union
        select '*' from {region}""",
    # One access request per event; clicks carry a document, errors a templated row.
    "requests": """
        select e.event_id, e.ts, e.user_id, e.event_type, e.value,
          case user_id % 3 when 0 then 'agent' when 1 then 'user' else 'service' end as principal_type,
          concat(case user_id % 3 when 0 then 'agent:' when 1 then 'user:' else 'service:' end,
            cast(user_id as string)) as principal_id,
          case when event_id % 5 = 0 then 'high' end as claimed_tier,
          case event_type when 'view' then 'read' when 'click' then 'infer' when 'signup' then 'export'
            when 'error' then 'return' else 'search' end as action,
          case event_id % 6
            when 0 then concat('pg://', lower(r_name), '.', lower(n_name))
            when 1 then concat('pg://', lower(r_name), '.nation_', cast(event_id % 40 as string))
            when 2 then concat('s3://', lower(p_type), '/', cast(p_partkey as string))
            when 3 then concat('model://vendor', cast(s_nationkey as string), '/m', cast(s_suppkey as string))
            when 4 then concat('mcp://srv/', event_type, '_tool')
            else concat('pg://', lower(r_name), '.', lower(n_name)) end as urn,
          case when event_id % 10 = 3 then 'pii.dob' end as declared_label,
          case when event_id % 4 < 2 then 'external' when event_id % 4 = 2 then 'internal' end as destination,
          case event_id % 9 when 0 then 'training' when 1 then 'support' when 2 then 'analytics' end as purpose,
          coalesce(d.text, t.text) as payload
        from (
          select *,
            case when event_type = 'click' then event_id % (select count(*) from {documents}) end as doc_key,
            case when event_type = 'error' then event_id % (select count(*) from {customer}) end as row_key,
            event_id % (select count(*) from {part}) as part_key, event_id % (select count(*) from {supplier}) as supp_key
          from {events}) e
        join {nation} n on n.n_nationkey = e.event_id % 25
        join {region} r on r.r_regionkey = n.n_regionkey
        join {part} p on p.p_partkey = e.part_key
        join {supplier} s on s.s_suppkey = e.supp_key
        left join {documents} d on d.doc_id = e.doc_key
        left join {sensitive_text} t on t.row_id = e.row_key""",
    # Decisions as recorded, what was reported about them, and approval tickets.
    "decisions": """
        select event_id as decision_id, ts, concat('agent:', cast(user_id as string)) as principal_id, event_type as action,
          concat('pg://t', cast(event_id % 50 as string)) as resource_urn,
          case event_type when 'error' then 'deny' when 'signup' then 'require_approval' else 'allow' end as effect,
          case when event_id % 13 <> 0 then concat('p', cast(user_id % 30 as string)) end as determining_policy,
          case when event_type in ('view', 'click', 'purchase') then
            case event_id % 4 when 1 then 'enforced' when 2 then 'refused' when 3 then 'partial' end end as outcome,
          value * 3 as latency_ms, cast(event_id % 5 as bigint) as redaction_count,
          case event_id % 3 when 0 then 'pii.email' when 1 then 'pii.email,phi.mrn' else '' end as labels_text,
          case when event_id % 2 = 0 then concat('p', cast(user_id % 30 as string), ',base') else 'base' end as matched_text,
          case event_id % 4 when 0 then 'redact,watermark' when 1 then 'watermark' when 2 then 'redact' else '' end as unsupported_text,
          md5(concat(cast(user_id as string), event_type, cast(event_id % 3 as string))) as request_fingerprint
        from {events}""",
    "reports": """
        select event_id * 2 as report_id, event_id as decision_id, ts + interval '1' hour as reported_at,
          case event_id % 5 when 0 then 'refused' when 1 then 'partial' when 2 then 'lost' else 'enforced' end as outcome,
          case when event_id % 3 = 0 then '' else 'because' end as reason,
          case when event_id % 2 = 0 then 'redact,watermark' else 'limit' end as discharged_text,
          case when event_id % 7 = 0 then '' else 'route' end as undischarged_text
        from {events}
        union all
        select event_id * 2 + 1, event_id, ts + interval '2' hour,
          case when event_id % 4 < 2 then 'enforced' else 'refused' end, 'again', '', ''
        from {events} where event_type <> 'view'""",
    "tickets": """
        select event_id as approval_id, event_id as decision_id, ts as created_at, ts + interval '24' hour as expires_at,
          md5(concat(cast(user_id as string), event_type, cast(event_id % 3 as string))) as fingerprint,
          concat('agent:', cast(user_id as string)) as requested_by,
          case event_id % 5 when 0 then 'pending' when 1 then 'denied' when 2 then 'expired' else 'granted' end as status,
          case when event_id % 5 > 2 then 'user:boss' end as decided_by,
          case when event_id % 5 > 2 then ts + interval '1' hour end as resolved_at,
          case when event_id % 10 = 3 then ts + interval '2' hour end as redeemed_at,
          case when event_id % 20 = 3 then 'agent:x' end as redeemed_by
        from {events} where event_type = 'signup'""",
    # The state before: some rows are not there yet, some differ, and some are gone by now.
    "past_assets": """
        select urn, name, kind, case when length(urn) % 3 = 0 then 'nobody' else owner end as owner,
          case when length(name) % 4 = 0 then cast(null as string) else description end as description
        from {assets} where length(name) % 5 <> 0
        union all select concat('old://', cast(p_partkey as string)), p_name, 'file', p_brand, p_type from {part}""",
    "past_labels": """
        select urn, label from {asset_labels} where source <> 'scan'
        union all select urn, 'phi.icd10' from {assets} where length(urn) % 4 = 0""",
    "past_principals": """
        select external_id, type, display_name, case when external_id like '%1' then 'low' else trust_tier end as trust_tier
        from {principals} where external_id not like '%5'
        union all select concat('gone:', cast(s_suppkey as string)), 'user', s_name, 'low' from {supplier}""",
    "policies_now": "select concat('p', cast(p_partkey as string)) as key, p_name as document, p_size % 2 = 0 as enabled from {part}",
    "past_policies": """
        select concat('p', cast(p_partkey as string)) as key, case when p_size % 3 = 0 then 'old' else p_name end as document,
          p_size % 5 <> 0 as enabled from {part} where p_size % 7 <> 0
        union all select concat('s', cast(s_suppkey as string)), s_name, true from {supplier}""",
    "past_tickets": """
        select approval_id, case when approval_id % 5 in (1, 3) then 'pending' else status end as status,
          cast(null as timestamp) as redeemed_at from {tickets} where approval_id % 4 <> 0""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, DERIVED[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over given and derived tables, named in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in needs(sql)})


def _closure(names: list[str], seen: dict[str, None]) -> None:
    for name in names:
        if name in DERIVED and name not in seen:
            _closure(needs(DERIVED[name]), seen)
            seen[name] = None


def duck(sql: str, recursive: bool = False) -> str:
    """The same SQL for DuckDB, derived tables spelled out ahead of it.

    ``sql`` may itself start with ``with``; its parts follow the derived tables.
    """
    seen: dict[str, None] = {}
    _closure(needs(sql), seen)
    parts = []
    for name in seen:
        body = DERIVED[name]
        parts.append(f"{name} as ({body.format(**{n: n for n in needs(body)})})")
    text = sql.format(**{n: n for n in needs(sql)}).strip()
    own = re.match(r"with(\s+recursive)?\s", text, re.I)
    if own:
        recursive = recursive or bool(own.group(1))
        text = text[own.end():]
        joined = ",\n".join(parts)
        head = f"with {'recursive ' if recursive else ''}"
        return head + (joined + ",\n" if parts else "") + text
    return (f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + text
