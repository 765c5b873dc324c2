"""Queries run as streams over files, each checked against the same SQL as a batch would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import policy, redact, scan
from lakewarden.plans import derived, oracle, q_audit, q_decide
from lakewarden.plans.registry import query
from lakewarden.plans.requests import KEY, as_requests, asset_labels, catalog_assets, catalog_principals
from lakewarden.session import cut, spread
from lakewarden.streaming import holdback, jobs
from lakewarden.streaming.runs import file_stream, into_table

CHUNK = 64

#: Answers carrying a secret are refused; personal values in the others are rewritten.
ANSWER_RULES = [
    {"key": "no-secrets", "effect": "deny", "priority": 9, "match": {"findings": {"any_of": ["secret"]}}},
    {"key": "masked", "effect": "allow", "match": {},
     "obligations": [{"type": "redact", "labels": ["pii.email", "pii.phone", "pci.card_number"], "strategy": "mask"}]},
]


def govern(prefixes: DataFrame) -> DataFrame:
    """Scan, decide and rewrite a table of prefixes; the same on a batch and on a stream."""
    found = scan.with_findings(prefixes, "prefix", output="prefix_findings")
    found = found.withColumn("findings", scan.labels_of(F.col("prefix_findings")))
    out = policy.evaluate(found, ANSWER_RULES)
    allowed = F.col("effect") == "allow"
    out = redact.with_redaction(out, "prefix", "prefix_findings", "obligations", KEY, when=allowed)
    return out.withColumn("refusal", F.when(~allowed, F.col("reason"))).withColumnRenamed("redacted", "governed")


def find(stretches: DataFrame) -> DataFrame:
    """Scan a table of stretches; the same on a batch and on a stream."""
    return holdback.hits(scan.with_findings(stretches, "tail", output="found"), "found")


def judge(found: DataFrame) -> DataFrame:
    """Decide stretches by the labels known at each, and find what to rewrite."""
    out = policy.evaluate(found, ANSWER_RULES)
    allowed = F.col("effect") == "allow"
    out = redact.with_redaction(out, "tail", "hits", "obligations", KEY, when=allowed)
    return out.withColumns({"refusal": F.when(~allowed, F.col("reason")), "ways": holdback.ways(F.col("obligations"), F.col("findings"))})


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of the corpus cut into chunks, as a model would produce it."""
    # A table may be one split, and cutting it up is work for every core.
    corpus = spread(derived.table(spark, sf, "corpus")).where(F.length("text") > 0)
    cut_up = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    # Cut before the pieces become rows, so that no row carries the whole text.
    rows = corpus.select(F.col("id").alias("completion_id"), F.size(cut_up).alias("n"), F.posexplode(cut_up).alias("seq", "delta"))
    return rows.select("completion_id", "seq", "delta", (F.col("seq") == F.col("n") - 1).alias("is_last"))


_DELIVERED = (
    "with " + oracle.scan_ctes()
    + """, refused as (select distinct id from kept where starts_with(label, 'secret.')),
steps as (select id, list({{'t': '', 's': s, 'e': e, 'r': '[REDACTED:' || label || ']'}} order by s desc) as es from kept where label in ('pii.email', 'pii.phone', 'pci.card_number') group by 1),
done as (select c.id, r.id is not null as refused, case when r.id is not null then '' when es is null then text else list_reduce(list_prepend({{'t': text, 's': 0::bigint, 'e': 0::bigint, 'r': ''}}, es),
  lambda a, x: {{'t': substr(a.t, 1, x.s) || x.r || substr(a.t, x.e + 1), 's': 0::bigint, 'e': 0::bigint, 'r': ''}}).t end as text, cast(length(text) // 512 + 1 as int) as decisions
  from {corpus} c left join refused r using (id) left join steps using (id) where length(text) > 0)"""
)
#: Held back at the end is what was not out after the last point before it: the governed text up to there less the window.
_ANSWERS = _DELIVERED + (
    ", shift as (select id, sum(length('[REDACTED:' || label || ']') - (e - s)) as more from kept join (select id, length(text) // 512 * 512 as p from {corpus}) using (id)"
    " where label in ('pii.email', 'pii.phone', 'pci.card_number') and e <= p group by id)"
    " select id as completion_id, refused, done.text, decisions, false as overran,"
    " case when not refused then cast(length(c.text) - greatest(0, length(c.text) // 512 * 512 + coalesce(more, 0) - 1024) as int) end as held_back"
    " from done join {corpus} c using (id) left join shift using (id)"
)


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("completion_id", F.col("refusal").isNotNull().alias("refused"), "text", "decisions", "overran", F.when(F.col("refusal").isNull(), F.col("held_back")).alias("held_back"))


@query("holdback_stream", _ANSWERS)
def holdback_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Answers governed while they are produced: a stream of chunks in, safe text out."""
    source = cut(chunks(spark, sf), "chunks")
    stream = file_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    return _answers(holdback.delivered(holdback.released(stream, find, judge)))


@query("holdback_batch", _ANSWERS)
def holdback_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a finished chunk table, without state."""
    return _answers(holdback.answers(judge(holdback.with_labels(find(holdback.stretches(chunks(spark, sf)))))))


@query("buffered_answers", _DELIVERED + " select id as completion_id, refused, case when not refused then text end as text from done")
def buffered_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Collect everything, decide once."""
    out = holdback.buffered(chunks(spark, sf), govern)
    return out.select("completion_id", F.col("refusal").isNotNull().alias("refused"), "text")


@query(
    "govern_points",
    "select id as completion_id, length(text) // 512 + 1 as prefixes, length(text) as longest, cast((512 * (length(text) // 512) * (length(text) // 512 + 1)) // 2 + length(text) as bigint) as governed_chars from {corpus} where length(text) > 0",
)
def govern_points(spark: SparkSession, sf: str) -> DataFrame:
    """When each answer is governed, and how much text that is in all: every prefix whole."""
    due = holdback.prefixes(chunks(spark, sf))
    return due.groupBy("completion_id").agg(
        F.count("*").alias("prefixes"), F.max("seen").cast("bigint").alias("longest"), F.sum(F.length("prefix")).alias("governed_chars")
    )


@query("decide_stream", q_decide.FACTS + " select event_id as request_id, effect, case when len(keys) > 0 then top end as determining_policy, target from final")
def decide_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Requests decided as they arrive; catalog and policies are read anew per batch."""
    source = cut(derived.table(spark, sf, "requests"), "requests")
    stream = file_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)

    def job(batch: DataFrame) -> DataFrame:
        from lakewarden.operators import decide

        out = decide.decide(
            as_requests(batch), catalog_principals(spark, sf), catalog_assets(spark, sf), asset_labels(spark, sf), q_decide.POSTURE, KEY
        )
        return out.select("request_id", "effect", "determining_policy", F.col("route.target").alias("target"))

    return jobs.decide_stream(stream, job)


@query("seal_stream", q_audit._chain_sql() + " select stream, seq, subject, record_hash from chain")
def seal_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records sealed on a stream: the same chains as the batch job."""
    source = cut(q_audit.records(spark, sf), "audit-input")
    stream = file_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    return jobs.seal_stream(stream, KEY).select("stream", "seq", "subject", "record_hash")


@query(
    "unmatched_outcomes",
    "with d as (select decision_id, ts from {decisions} where effect = 'allow'), r as (select decision_id as rid, reported_at, outcome from {reports}),"
    " edge as (select least((select max(ts) from d), (select max(reported_at) from r)) as mark)"
    " select decision_id, outcome as reported from d join r on rid = decision_id and reported_at between ts and ts + interval '90' minute"
    " union all select decision_id, null from d, edge where ts + interval '90' minute < mark and not exists (select 1 from r where rid = decision_id and reported_at between ts and ts + interval '90' minute)",
)
def unmatched_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams joined in time; what stays alone past the bound is unreported."""
    d = cut(derived.table(spark, sf, "decisions").select("decision_id", "effect", F.col("ts").cast("timestamp").alias("decided_at")), "decisions")
    r = cut(derived.table(spark, sf, "reports").select("decision_id", "outcome", F.col("reported_at").cast("timestamp").alias("reported_at")), "reports")

    def streamed(t: DataFrame) -> DataFrame:
        return file_stream(spark, t.inputFiles()[0].rsplit("/", 1)[0], t.schema)

    matched = into_table(jobs.unmatched(streamed(d), streamed(r), late="0 seconds", within="90 minutes"), "matched")
    return matched.select("decision_id", "reported")


_EDGES = ", ".join(
    f"count(*) filter (where latency_ms <= {e}) as le_{str(e).replace('.', '_')}" for e in jobs.outcomes.LATENCY_EDGES_MS
)


@query(
    "metrics_stream",
    "with w as (select date_trunc('hour', ts) as start, * from {decisions}), edge as (select max(ts) as mark from {decisions})"
    f" select epoch_us(start) as start, effect, count(*) as n, cast(sum(redaction_count) as bigint) as redactions, {_EDGES} from w, edge where start + interval '1' hour <= mark group by 1, 2",
)
def metrics_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts and latency histograms, each window emitted once it is closed."""
    source = cut(
        derived.table(spark, sf, "decisions").select("effect", "latency_ms", "redaction_count", F.col("ts").cast("timestamp").alias("ts")), "decisions"
    )
    stream = file_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    out = into_table(jobs.decision_metrics(stream, "ts", "1 hour", late="0 seconds"), "metrics")
    return out.withColumn("start", F.unix_micros("start")).drop("end")


@query(
    "decision_metrics",
    f"select epoch_us(date_trunc('minute', ts)) as start, effect, count(*) as n, cast(sum(redaction_count) as bigint) as redactions, {_EDGES} from {{decisions}} group by 1, 2",
)
def decision_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "decisions").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.decision_metrics(rows).withColumn("start", F.unix_micros("start")).drop("end")


@query(
    "label_metrics",
    "select epoch_us(date_trunc('hour', ts)) as start, label, count(*) as n from (select ts, unnest(string_split(labels_text, ',')) as label from {decisions}) t where label <> '' group by 1, 2",
)
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by label and hour; redactions by strategy and load errors by policy count the same way."""
    rows = derived.table(spark, sf, "decisions").select(F.col("ts").cast("timestamp").alias("ts"), F.explode(F.split("labels_text", ",")).alias("label"))
    return jobs.counted_metrics(rows.where("label <> ''"), "ts", "label", "1 hour").withColumn("start", F.unix_micros("start"))


@query(
    "ticket_expiry_stream",
    "with v as (select event_id as approval_id, event_id % 3 as k, ts, ts + interval '24' hour as due, ts + case when event_id % 3 = 0 then interval '30' hour else interval '2' hour end as voted from {events} where event_type = 'signup'),"
    " edge as (select greatest(max(ts), max(case when k < 2 then voted end)) as mark from v)"
    " select approval_id, case when k = 1 then 'granted' else 'expired' end as status from v, edge where k < 2 or due < mark",
)
def ticket_expiry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets granted in time, voted on too late, or run out by event time."""
    opened = derived.run(
        spark, sf, "select event_id as approval_id, 'opened' as kind, ts as made_at, ts + interval '24' hour as expires_at from {events} where event_type = 'signup'"
    )
    votes = derived.run(
        spark, sf,
        "select event_id as approval_id, 'granted' as kind, ts + case when event_id % 3 = 0 then interval '30' hour else interval '2' hour end as made_at,"
        " ts + interval '24' hour as expires_at from {events} where event_type = 'signup' and event_id % 3 < 2",
    )
    rows = opened.unionByName(votes).select(
        "approval_id", "kind", F.col("made_at").cast("timestamp").alias("at"), F.col("expires_at").cast("timestamp").alias("expires_at")
    )
    source = cut(rows, "ticket-events")
    stream = file_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    return jobs.settle_tickets(stream, late="0 seconds")
