"""Queries over audit chains and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import crypto
from lakewarden.operators import audit, changes, scan
from lakewarden.plans import derived, oracle
from lakewarden.plans.registry import query
from lakewarden.plans.requests import KEY
from lakewarden.session import cut, fresh_path
from lakewarden.sources import sinks

STREAMS = 8

#: The audit input every check uses: one decision event per row of ``events``, dated by the day,
#: so that many records share a time and only their number orders them.
_STREAM = f"'p' || (user_id % {STREAMS})"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') end || '+00:00'"
_PAYLOAD = "'{{\"action\":\"' || event_type || '\",\"amount\":' || cast(value as varchar) || ',\"props\":\"' || replace(props, '\"', '\\\"') || '\"}}'"


def _body(prev: str, seq: str) -> str:
    return (
        f"('{{{{\"actor\":\"' || actor || '\",\"event\":\"decision\",\"payload\":' || payload || ',\"prev_hash\":\"' || {prev} || '\",\"seq\":' || {seq}"
        " || case when stream = 'default' then '' else ',\"stream\":\"' || stream || '\"' end || ',\"subject\":\"' || subject || '\",\"timestamp\":\"' || iso || '\"}}')"
    )


def _digest(prev: str, seq: str) -> str:
    return oracle.hmac_sql(KEY, f"encode({_body(prev, seq)})")


def _input_sql(stream: str) -> str:
    return (
        f"inp as (select event_id, ts, {stream} as stream, 'agent:' || user_id as actor, 'e' || event_id as subject, {_PAYLOAD} as payload, {_ISO} as iso,"
        f" row_number() over (partition by {stream} order by ts, event_id) as seq from (select * replace (date_trunc('day', ts) as ts) from {{events}}) e)"
    )


def _chain_sql(stream: str = _STREAM) -> str:
    """The chain by recursion: one step per sequence number, all streams at once."""
    zero = "'" + audit.GENESIS + "'"
    return (
        f"with recursive {_input_sql(stream)},\nchain as (select event_id, ts, stream, actor, subject, payload, iso, seq, {zero} as prev_hash, {_digest(zero, '1')} as record_hash from inp where seq = 1"
        f" union all select i.event_id, i.ts, i.stream, i.actor, i.subject, i.payload, i.iso, i.seq, c.record_hash, {_digest('c.record_hash', 'i.seq').replace('actor', 'i.actor').replace('|| payload', '|| i.payload').replace('when stream', 'when i.stream').replace('|| stream', '|| i.stream').replace('|| subject', '|| i.subject').replace('|| iso', '|| i.iso')}"
        " from chain c join inp i on i.stream = c.stream and i.seq = c.seq + 1)"
    ).replace('"i.actor"', '"actor"').replace('\\"i.actor\\"', '\\"actor\\"')


def records(spark: SparkSession, sf: str, stream=None) -> DataFrame:
    events = derived.table(spark, sf, "events")
    payload = F.struct(
        F.col("event_type").alias("action"), F.col("value").alias("amount"), F.col("props").alias("props")
    )
    rows = audit.events(
        events.withColumn("user", F.col("user_id").cast("string")),
        "decision",
        F.date_trunc("day", F.col("ts").cast("timestamp")),
        F.concat(F.lit("agent:"), F.col("user")),
        F.concat(F.lit("e"), F.col("event_id").cast("string")),
        payload,
        F.col("event_id"),
    )
    number = F.regexp_extract("actor", r"(\d+)$", 1).cast("bigint")
    chosen = F.concat(F.lit("p"), (number % STREAMS).cast("string")) if stream is None else stream
    return rows.withColumn("stream", chosen)


def sealed(spark: SparkSession, sf: str) -> DataFrame:
    """The sealed log, written once so that every later reader sees the same records."""
    return cut(audit.seal(records(spark, sf), KEY), "audit")


@query("canonical_json", "select event_id, " + _PAYLOAD + " as payload, true as ascii_only from {events}")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted keys, no spaces, quotes escaped, ASCII only."""
    number = F.regexp_extract("subject", r"(\d+)", 1).cast("bigint")
    ascii_only = F.col("payload").rlike("^[ -~]*$")
    return records(spark, sf).select(number.alias("event_id"), "payload", ascii_only.alias("ascii_only"))


@query(
    "json_escaping",
    "select doc_id, true as ascii_only, text = text as round_trip from {documents}",
)
def json_escaping(spark: SparkSession, sf: str) -> DataFrame:
    """Any text becomes pure-ASCII JSON and reads back unchanged."""
    docs = derived.table(spark, sf, "documents").withColumn("j", crypto.json_string(F.col("text")))
    back = F.try_variant_get(F.try_parse_json("j"), "$", "string")
    return docs.select("doc_id", F.col("j").rlike("^[ -~]*$").alias("ascii_only"), (back == F.col("text")).alias("round_trip"))


@query("record_digest", f"with {_input_sql(_STREAM)} select event_id, {_digest(repr(audit.GENESIS), 'event_id')} as digest from inp")
def record_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A record's digest is a function of its own row."""
    rows = records(spark, sf).withColumns(
        {"seq": F.regexp_extract("subject", r"(\d+)", 1).cast("bigint"), "prev_hash": F.lit(audit.GENESIS)}
    )
    return rows.select(F.col("seq").alias("event_id"), audit.record_digest(KEY).alias("digest"))


@query("seal_chain", _chain_sql() + " select stream, seq, subject, prev_hash, record_hash from chain")
def seal_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Eight chains sealed side by side."""
    return audit.seal(records(spark, sf), KEY).select("stream", "seq", "subject", "prev_hash", "record_hash")


_DAILY = f"{_STREAM} || '/' || strftime(ts, '%Y-%m-%d')"


@query("seal_segmented", _chain_sql(_DAILY) + " select stream, seq, subject, record_hash from chain")
def seal_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """Every stream cut into a chain per day, so that a busy one spreads over tasks."""
    rows = records(spark, sf)
    rows = rows.withColumn("stream", audit.segmented(F.col("stream"), F.date_format("timestamp", "yyyy-MM-dd")))
    return audit.seal(rows, KEY).select("stream", "seq", "subject", "record_hash")


@query("seal_continued", _chain_sql() + " select stream, seq, record_hash from chain")
def seal_continued(spark: SparkSession, sf: str) -> DataFrame:
    """Sealing in two batches, the second from the heads of the first, gives the same chains."""
    rows = records(spark, sf)
    early = F.col("timestamp") < F.to_timestamp(F.lit("2024-01-12 00:00:00"))
    first = cut(audit.seal(rows.where(early), KEY), "audit")
    second = audit.seal(rows.where(~early), KEY, audit.stream_heads(first))
    return first.unionByName(second).select("stream", "seq", "record_hash")


#: CRC-32 bit by bit: a byte is folded in, then shifted out in eight steps marked -1.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(length(actor)), lambda i:"
    " list_concat([ord(substr(actor, i + 1, 1))::bigint], list_transform(range(8), lambda k: -1::bigint))))),"
    " lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end), 4294967295::bigint)"
)


@query(
    "stream_assignment",
    f"select actor, 'p' || ({_CRC} % {STREAMS}) as stream, n from (select 'agent:' || user_id as actor, count(*) as n from {{events}} group by 1) t",
)
def stream_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """An actor's records all go to one stream, chosen by the actor's checksum."""
    actor = F.concat(F.lit("agent:"), F.col("user_id").cast("string"))
    rows = derived.table(spark, sf, "events").withColumn("actor", actor)
    named = rows.select("actor", audit.stream_of(F.col("actor"), STREAMS).alias("stream"))
    return named.groupBy("actor", "stream").agg(F.count("*").alias("n"))


@query("stream_heads", _chain_sql() + " select stream, max(seq) as seq, arg_max(record_hash, seq) as head_hash from chain group by 1")
def stream_heads(spark: SparkSession, sf: str) -> DataFrame:
    return audit.stream_heads(audit.seal(records(spark, sf), KEY))


def with_checkpoint(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    log = sealed(spark, sf)
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    row = audit.seal(audit.checkpoint_input(audit.stream_heads(log), at), KEY)
    return log, cut(row, "checkpoint")


_HEADS = ", h as (select stream, max(seq) as seq, arg_max(record_hash, seq) as head_hash from chain group by 1)"


@query(
    "checkpoint",
    _chain_sql() + _HEADS
    + ", j as (select '{{\"stream_count\":' || count(*) || ',\"streams\":[' || string_agg('{{\"head_hash\":\"' || head_hash || '\",\"seq\":' || seq || ',\"stream\":\"' || stream || '\"}}', ',' order by stream)"
    " || '],\"total_records\":' || cast(sum(seq) as bigint) || '}}' as payload from h) select '_checkpoints' as stream, 1 as seq, payload from j",
)
def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """One record that vouches for where every stream had reached."""
    return with_checkpoint(spark, sf)[1].select("stream", "seq", "payload")


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    """p0: a payload changed; p1: a record deleted; p2: a record moved to p3; p4: gone; p5: cut short."""
    log, check = with_checkpoint(spark, sf)
    s, n = F.col("stream"), F.col("seq")
    out = log.where(~((s == "p1") & (n == 5)) & (s != "p4") & ~((s == "p5") & (n > 20)))
    out = out.withColumn("payload", F.when((s == "p0") & (n == 7), F.lit('{"action":"none"}')).otherwise(F.col("payload")))
    out = out.withColumn("stream", F.when((s == "p2") & (n == 9), F.lit("p3")).otherwise(s))
    return cut(out.unionByName(check), "tampered")


@query(
    "verify_chain",
    _chain_sql() + " select stream, count(*) as checked, cast(0 as bigint) as corrupted, cast(0 as bigint) as broken_links, cast(0 as bigint) as sequence_errors, true as valid,"
    " 'chain intact across ' || count(*) || ' record(s)' as message from chain group by 1",
)
def verify_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Digests, links and numbering of intact chains; small blocks exercise the carried links."""
    return audit.verify(sealed(spark, sf), KEY, block=100)


_TAMPER = (
    ", t as (select case when stream = 'p2' and seq = 9 then 'p3' else stream end as stream, seq, prev_hash, record_hash,"
    " (stream = 'p0' and seq = 7) or (stream = 'p2' and seq = 9) as bad from chain"
    " where not (stream = 'p1' and seq = 5) and stream <> 'p4' and not (stream = 'p5' and seq > 20)),"
    " l as (select *, lag(record_hash, 1, '" + audit.GENESIS + "') over w as before, lag(seq) over w as before_seq from t window w as (partition by stream order by seq, record_hash))"
)


@query(
    "verify_tampered",
    _chain_sql() + _TAMPER
    + " select stream, count(*) as checked, count(*) filter (where bad) as corrupted, count(*) filter (where prev_hash <> before) as broken_links,"
    " count(*) filter (where before_seq is not null and seq <> before_seq + 1) as sequence_errors from l group by 1",
)
def verify_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Every fault is reported, not just the first."""
    log = tampered(spark, sf).where(F.col("stream") != audit.CHECKPOINTS)
    return audit.verify(log, KEY, block=100).select("stream", "checked", "corrupted", "broken_links", "sequence_errors")


@query(
    "chain_faults",
    _chain_sql() + _TAMPER
    + " select stream, seq, bad as corrupted, prev_hash <> before as broken_link, coalesce(seq <> before_seq + 1, false) as sequence_error from l"
    " where bad or prev_hash <> before or coalesce(seq <> before_seq + 1, false)",
)
def chain_faults(spark: SparkSession, sf: str) -> DataFrame:
    log = tampered(spark, sf).where(F.col("stream") != audit.CHECKPOINTS)
    found = audit.faults(log, KEY, block=100)
    return found.where(F.col("corrupted") | F.col("broken_link") | F.col("sequence_error"))


@query(
    "verify_range",
    _chain_sql()
    + " select stream, case when stream = 'p1' then count(*) filter (where seq between 6 and 30) else count(*) filter (where seq between 6 and 30) end as checked, stream <> 'p1' as valid,"
    " case when stream = 'p1' then 'cannot verify p1 from seq 6: record 5 is missing, so the starting link is unknown' else 'chain intact across ' || count(*) filter (where seq between 6 and 30) || ' record(s)' end as message from chain group by 1",
)
def verify_range(spark: SparkSession, sf: str) -> DataFrame:
    """A slice starts from its predecessor's digest; without one it cannot be verified."""
    log = sealed(spark, sf)
    holed = log.where(~((F.col("stream") == "p1") & (F.col("seq") == 5)))
    return audit.verify_range(holed, KEY, 6, 30, block=10).select("stream", "checked", "valid", "message")


@query(
    "verify_checkpoint",
    _chain_sql() + _HEADS
    + " select stream, seq as vouched_seq, case when stream = 'p4' then null when stream = 'p5' then 20 else seq end as reached,"
    " case when stream = 'p4' then 'missing' when stream = 'p5' then 'truncated' else 'intact' end as state from h",
)
def verify_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Streams the checkpoint vouched for that are gone or shorter now."""
    return audit.against_checkpoint(tampered(spark, sf))


@query(
    "verify_all",
    _chain_sql() + " select count(distinct stream) + 1 as streams, count(*) + 1 as records, count(distinct stream) as vouched, true as valid,"
    " (count(distinct stream) + 1) || ' stream(s) intact across ' || (count(*) + 1) || ' record(s); checkpoint matches' as message from chain",
)
def verify_all(spark: SparkSession, sf: str) -> DataFrame:
    log, check = with_checkpoint(spark, sf)
    return audit.verify_all(log.unionByName(check), KEY, block=200)


@query(
    "list_audit_records",
    f"with {_input_sql(_STREAM)} select stream, seq, subject from inp where actor = 'agent:3' order by ts desc, stream, seq desc limit 100 offset 2",
)
def list_audit_records(spark: SparkSession, sf: str) -> DataFrame:
    """A page of one actor's records, newest first."""
    log = audit.seal(records(spark, sf), KEY)
    return audit.listing(log, actor="agent:3", limit=100, offset=2).select("stream", "seq", "subject")


@query("audit_counts", f"select count(*) as records, count(distinct user_id % {STREAMS}) as streams, 1 as events from {{events}}")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts(audit.seal(records(spark, sf), KEY))


_EVENT_OF = {"decision": "view", "decision.outcome": "click", "approval.requested": "signup", "tokens.reversed": "error", "asset.classified": "purchase"}


@query(
    "audit_event_union",
    "select case event_type " + " ".join(f"when '{v}' then '{k}'" for k, v in _EVENT_OF.items()) + " end as event, count(*) as n, count(distinct user_id) as actors from {events} group by 1",
)
def audit_event_union(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of several kinds as one audit input."""
    events = derived.table(spark, sf, "events")
    union = None
    for name, kind in _EVENT_OF.items():
        rows = audit.events(
            events.where(F.col("event_type") == kind),
            name,
            F.col("ts"),
            F.col("user_id").cast("string"),
            F.col("event_id").cast("string"),
            F.struct("value"),
            F.col("event_id"),
        )
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"))


def _difference(now: str, past: str, key: str, fields: list[str], created: str, deleted: str, updated: str, gone: str = "''") -> str:
    """Events of two snapshots by a full join: which event, its key, and the fields that differ."""
    names = " || ".join(f"case when a.{f} is distinct from b.{f} then ',{f}' else '' end" for f in fields)
    return (
        f"select case when b.{key} is null then '{created}' when a.{key} is null then '{deleted}' else '{updated}' end as event, coalesce(a.{key}, b.{key}) as subject,"
        f" case when b.{key} is null then '' when a.{key} is null then {gone} else substr({names}, 2) end as fields"
        f" from {now} a full join {past} b on a.{key} = b.{key} where a.{key} is null or b.{key} is null or ({names}) <> ''"
    )


@query(
    "change_feed",
    _difference("{assets}", "{past_assets}", "urn", ["name", "kind", "owner", "description"], "asset.registered", "asset.deleted", "asset.updated")
    + " union all select 'asset.classified', urn, string_agg(sign || label, ',' order by sign || label) from (select urn, label, case when min(side) = 1 then '+' else '-' end as sign"
    " from (select distinct urn, label, 1 as side from {asset_labels} union all select distinct urn, label, 0 from {past_labels}) group by urn, label having count(*) = 1) group by urn"
    + " union all "
    + _difference("{principals}", "{past_principals}", "external_id", ["type", "display_name", "trust_tier"], "principal.created", "principal.updated", "principal.updated", "'removed'")
    + " union all "
    + _difference("{policies_now}", "{past_policies}", "key", ["document"], "policy.created", "policy.deleted", "policy.updated")
    + " union all select case when a.enabled then 'policy.enabled' else 'policy.disabled' end, a.key, '' from {policies_now} a join {past_policies} b on a.key = b.key where a.enabled <> b.enabled"
    " union all select unnest(list_filter([case when b.approval_id is null then 'approval.requested' end, case when a.status = 'granted' and coalesce(b.status, '') <> 'granted' then 'approval.granted' end,"
    " case when a.status = 'denied' and coalesce(b.status, '') <> 'denied' then 'approval.denied' end, case when a.redeemed_at is not null and b.redeemed_at is null then 'approval.redeemed' end], lambda x: x is not null)),"
    " cast(a.approval_id as varchar), '' from {tickets} a left join {past_tickets} b on a.approval_id = b.approval_id"
    " union all select 'decision', cast(decision_id as varchar), '' from {decisions}"
    " union all select case when rn = 1 then 'decision.outcome' else 'decision.outcome_conflict' end, cast(decision_id as varchar), outcome"
    " from (select *, row_number() over w as rn, first_value(outcome) over w as told from {reports} window w as (partition by decision_id order by reported_at, report_id)) where rn = 1 or outcome <> told",
)
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events of eighteen kinds, each from the job that causes it."""
    now = lambda name: derived.table(spark, sf, name)
    feeds = [
        changes.assets(now("past_assets"), now("assets")),
        changes.classified(now("past_labels"), now("asset_labels")),
        changes.principals(now("past_principals"), now("principals")),
        changes.policies(now("past_policies"), now("policies_now")),
        changes.approvals(now("past_tickets"), now("tickets")),
        changes.decisions(now("decisions")),
        changes.reports(now("reports")),
    ]
    union = feeds[0]
    for more in feeds[1:]:
        union = union.unionByName(more)
    return union.select("event", "subject", F.array_join("fields", ",").alias("fields"))


@query("append_only_sink", f"select 'p' || (user_id % {STREAMS}) as stream, count(*) as records, count(*) as top from {{events}} group by 1")
def append_only_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a log laid out by stream; the second continues the first."""
    path = fresh_path(spark, "log")
    rows = records(spark, sf)
    early = F.col("timestamp") < F.to_timestamp(F.lit("2024-01-12 00:00:00"))
    sinks.append_audit(audit.seal(rows.where(early), KEY), path)
    heads = audit.stream_heads(spark.read.parquet(path))
    sinks.append_audit(audit.seal(rows.where(~early), KEY, heads), path)
    return spark.read.parquet(path).groupBy("stream").agg(F.count("*").alias("records"), F.max("seq").alias("top"))


@query(
    "finding_sink",
    "with " + oracle.scan_ctes() + f" select id, label, cast(s as int) as start_at, {oracle.preview_sql('value')} as preview from kept",
)
def finding_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Findings stored and read back: masked, without the value."""
    path = fresh_path(spark, "findings")
    found = scan.scan(derived.table(spark, sf, "corpus"), "text", ["id"])
    sinks.append_records(found, path)
    back = spark.read.parquet(path)
    if "value" in back.columns:
        raise ValueError("a matched value reached the sink")
    return back.select("id", "label", F.col("start").alias("start_at"), "preview")
