from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit
from lakewarden.plans.q_stream import find, govern, judge
from lakewarden.session import fresh_path
from lakewarden.streaming import holdback, jobs
from lakewarden.streaming.runs import file_stream, folded, into_table

KEY = b"stream key"

FILLER = "The quick brown fox jumps over the lazy dog. " * 40
TEXTS = {
    "plain": FILLER,
    "short": "hello",
    "mail": "x" * 500 + " write to ann@example.com soon " + FILLER,
    "split": "y" * 1020 + " card 4111 1111 1111 1111 then " + FILLER,
    "secret": FILLER + " password: abcdef123 " + FILLER,
    "early": "password: abcdef123 " + FILLER,
}


def parts(spark, folder, size, files):
    """Chunks written as several files, one micro-batch each, in order of arrival."""
    rows = []
    for name, text in TEXTS.items():
        cuts = [text[i : i + size] for i in range(0, len(text), size)]
        rows += [(name, i, d, i == len(cuts) - 1) for i, d in enumerate(cuts)]
    rows.sort(key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // files)
    schema = "completion_id string, seq int, delta string, is_last boolean"
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("size, files", [(64, 3), (333, 2)])
def test_stream_equals_batch(spark, size, files):
    folder = fresh_path(spark, "chunks")
    chunks = parts(spark, folder, size, files)
    batch = {r.completion_id: r for r in holdback.outcomes(govern(holdback.prefixes(chunks))).collect()}
    stream = file_stream(spark, folder, chunks.schema, per_batch=1)
    out = {r.completion_id: r for r in holdback.delivered(holdback.released(stream, find, judge)).collect()}
    for name in TEXTS:
        a, b = batch[name], out[name]
        assert (a.text, a.refusal, a.decisions, a.overran) == (b.text, b.refusal, b.decisions, b.overran), name
        assert a.held_back == b.held_back, name
    assert out["plain"].text == FILLER and out["short"].text == "hello"
    assert "ann@" not in out["mail"].text and "[REDACTED:pii.email]" in out["mail"].text
    assert "4111" not in out["split"].text
    assert out["early"].text == "" and out["early"].refusal
    assert out["secret"].refusal and "abcdef123" not in out["secret"].text
    assert FILLER.startswith(out["secret"].text[: len(FILLER)])


def in_stretches(chunks, every=512, window=1024, reach=512):
    found = holdback.with_labels(find(holdback.stretches(chunks, every, reach)))
    return {r.completion_id: r[1:] for r in holdback.answers(judge(found), window, reach).orderBy("completion_id").collect()}


def whole_prefixes(chunks, every=512, window=1024):
    return {r.completion_id: r[1:] for r in holdback.outcomes(govern(holdback.prefixes(chunks, every)), window).collect()}


def answers_of(spark, texts, size):
    rows = [(k, i, t[i * size : i * size + size], (i + 1) * size >= len(t)) for k, t in texts.items() for i in range(-(-len(t) // size))]
    return spark.createDataFrame(rows, "completion_id string, seq int, delta string, is_last boolean")


@pytest.mark.parametrize("every, window, size", [(512, 1024, 64), (100, 300, 7), (64, 10, 33), (700, 0, 50), (1, 60, 90)])
def test_stretches_equal_whole_prefixes(spark, every, window, size):
    rng = random.Random(every)
    some = ["ann@example.com", "4111 1111 1111 1111", "+1 415 555 0132", "10.20.30.40", "plain", "words", "born 1990-01-02", "call", "card", "x" * 60, "1234 5678"]
    texts = {f"r{k}": " ".join(rng.choices(some, [3, 3, 3, 2, 40, 40, 2, 5, 5, 3, 3], k=rng.randint(1, 400 if every > 1 else 60))) for k in range(25)}
    texts |= {f"s{k}": f"{t} password: abc{k}def99 {t[:50]}" for k, t in enumerate(list(texts.values())[:6])}
    chunks = answers_of(spark, {**TEXTS, **texts} if every > 1 else texts, size)
    got, want = in_stretches(chunks, every, window), whole_prefixes(chunks, every, window)
    assert got == want
    assert any(r[1] for r in want.values())


def test_stretches_are_linear_in_the_text(spark):
    texts = {str(n): "word " * (n // 5) for n in (5_000, 50_000, 100_000)}
    chunks = answers_of(spark, texts, 64)
    read = {r[0]: r[1] for r in holdback.stretches(chunks).groupBy("completion_id").agg(F.sum(F.length("tail"))).collect()}
    assert all(read[k] <= 3 * len(t) + 1536 for k, t in texts.items())


def test_the_open_end_stays_small():
    import types

    answer, text, since = holdback.Answer(100, 80), "abcde fghij " * 500, 0
    out = []
    for seen in [*range(50, len(text), 50), len(text)]:
        at = max(0, since - 160)
        own = max(0, since - 80)
        row = types.SimpleNamespace(tail=text[at:seen], at=at, own=own, since=since, seen=seen, settled_to=max(0, seen - 80), final=seen == len(text), refusal=None, edits=[], ways=[], hits=[])
        out.append(answer.step(row)[0])
        since = seen
        assert len(answer.s["open"]) <= 200 and len(answer.s["out"]) <= 200
    assert "".join(out) == text


def test_duties_that_change_and_long_values_stop_an_answer():
    import types

    def row(**more):
        base = {"tail": "x" * 300, "at": 0, "own": 0, "since": 0, "seen": 300, "settled_to": 220, "final": False, "refusal": None, "edits": [], "ways": ["pii.email {}"], "hits": []}
        return types.SimpleNamespace(**base | more)

    hit = {"label": "pii.email", "start": 10, "end": 20}
    answer = holdback.Answer(50, 80)
    assert answer.step(row(hits=[hit]))[4] is False
    assert answer.step(row(tail="y" * 100, at=300, since=300, seen=400, settled_to=320, ways=["pii.email {\"s\":\"mask\"}"]))[4] is True
    assert answer.step(row()) is None
    assert holdback.Answer(50, 80).step(row(hits=[{**hit, "end": 60}]))[1] == holdback.OVERRUN


def test_a_value_longer_than_the_window_stops_the_stream(spark):
    text = "a " * 20 + "4111 1111 1111 1111 end" + " b" * 200
    rows = [("c", i, text[i * 10 : i * 10 + 10], i * 10 + 10 >= len(text)) for i in range(-(-len(text) // 10))]
    chunks = spark.createDataFrame(rows, "completion_id string, seq int, delta string, is_last boolean")
    # With hardly any window the card's first digits go out before the rest identifies it.
    row = holdback.outcomes(govern(holdback.prefixes(chunks, every=10)), window=4).first()
    assert row.overran and row.refusal == holdback.OVERRUN
    safe = holdback.outcomes(govern(holdback.prefixes(chunks, every=10)), window=64).first()
    assert not safe.overran and "[REDACTED:pci.card_number]" in safe.text


def test_sealing_over_batches_equals_one_batch(spark):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(f"p{i % 3}", base + timedelta(seconds=i), "decision", f"a{i}", f"s{i}", "{}", f"{i:04d}") for i in range(60)]
    schema = "stream string, timestamp timestamp, event string, actor string, subject string, payload string, ordinal string"
    folder = fresh_path(spark, "audit-in")
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    sealed = jobs.seal_stream(file_stream(spark, folder, spark.read.parquet(folder).schema, per_batch=1), KEY)
    whole = audit.seal(spark.createDataFrame(rows, schema), KEY)
    key = ["stream", "seq", "record_hash"]
    assert sorted(sealed.select(key).collect()) == sorted(whole.select(key).collect())
    assert all(r.valid for r in audit.verify(sealed, KEY).collect())


def test_rows_out_of_order_count_within_the_lateness(spark):
    base = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)
    folder = fresh_path(spark, "late-in")
    for minutes in (90, 30, 600):
        row = [(base + timedelta(minutes=minutes), "allow", 1.0, 0)]
        spark.createDataFrame(row, "ts timestamp, effect string, latency_ms double, redaction_count bigint").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    schema = spark.read.parquet(folder).schema
    stream = file_stream(spark, folder, schema, per_batch=1)
    assert into_table(jobs.decision_metrics(stream, "ts", "1 hour", late="2 hours"), "late").count() == 2
    with pytest.raises(ValueError, match="lateness"):
        jobs.decision_metrics(file_stream(spark, folder, schema))


def test_govern_points_counts_every_prefix_whole(spark, sf):
    """A point per 512 characters and the end, each with all of the text up to there."""
    from lakewarden.plans import derived
    from lakewarden.plans.q_stream import govern_points

    want = {}
    for r in derived.table(spark, sf, "corpus").where("length(text) > 0").select("id", F.length("text").alias("n")).collect():
        ends = [*range(512, r.n + 1, 512), r.n]
        want[r.id] = (len(ends), r.n, sum(ends))
    got = govern_points(spark, sf).select("completion_id", "prefixes", "longest", "governed_chars").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_a_fold_takes_a_key_as_a_flow_of_small_batches(spark):
    """No group stands in memory, and what a key leaves open comes back before its next rows."""

    class Sum:
        def __init__(self, state):
            self.n = int(state or 0)

        def take(self, row):
            self.n += row.v
            return [(row.k, row.v, self.n)]

        def left(self):
            return None if self.n > 10**6 else str(self.n)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500, 0, -1).select(F.when(F.col("id") > 100, "a").otherwise(F.lit(None)).alias("k"), F.col("id").alias("v"))
        schema = "k string, v bigint, n bigint"
        first, state = folded(rows, None, "k", [F.col("v")], Sum, schema)
        again, after = folded(rows.where("v = 500 or v = 1"), state, "k", [F.col("v")], Sum, schema)
        assert [r.n for r in first.where("k is null").orderBy("v").collect()] == [v * (v + 1) // 2 for v in range(1, 101)]
        whole = sum(range(101, 501))
        assert {r.k: r.n for r in again.collect()} == {"a": whole + 500, None: 5051}
        assert {r.k: r._state for r in after.collect()} == {"a": str(whole + 500), None: "5051"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tickets_settle_over_batches(spark):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda hours: base + timedelta(hours=hours)
    folder = fresh_path(spark, "tickets-in")
    schema = "approval_id bigint, kind string, at timestamp, expires_at timestamp"
    files = [
        [(1, "opened", at(0), at(24)), (2, "opened", at(0), at(24)), (3, "opened", at(0), at(90)), (4, "granted", at(1), at(24)), (None, "opened", at(1), at(25))],
        [(1, "granted", at(2), at(24)), (1, "denied", at(3), at(24)), (2, "granted", at(30), at(24)), (5, "opened", at(29), at(200)), (6, "opened", at(1), at(2))],
        [(3, "denied", at(40), at(90)), (5, "denied", at(41), at(200)), (5, "opened", at(42), at(300))],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    settled = jobs.settle_tickets(file_stream(spark, folder, spark.read.parquet(folder).schema, per_batch=1), late="0 seconds")
    got = sorted(((r.approval_id or 0, r.status) for r in settled.collect()))
    # The sixth came later than the mark; the last one opened is still pending.
    assert got == [(0, "expired"), (1, "granted"), (2, "expired"), (3, "denied"), (5, "denied")]
    empty = fresh_path(spark, "no-tickets")
    spark.createDataFrame([], schema).write.parquet(empty)
    assert jobs.settle_tickets(file_stream(spark, empty, settled.sparkSession.read.parquet(empty).schema), late="0 seconds").collect() == []


def test_answers_are_cut_up_on_all_cores(spark, sf):
    from lakewarden.plans import q_stream

    chunks = q_stream.chunks(spark, sf)
    assert "Repartition" in chunks._jdf.queryExecution().optimizedPlan().toString()


def test_python_gets_only_what_a_step_reads(spark):
    from lakewarden.plans import q_stream
    from lakewarden.streaming import holdback

    texts = [("a", "mail me at bob@mail.example.com or bob2@mail.example.com please"), ("b", "plain " * 300), ("c", "x")]
    rows = [(i, n, t[at : at + 64]) for i, t in texts for n, at in enumerate(range(0, len(t), 64))]
    chunks = spark.createDataFrame(rows, "completion_id string, seq int, delta string")
    judged = q_stream.judge(holdback.with_labels(q_stream.find(holdback.stretches(chunks))))
    out = holdback.answers(judged)
    field = next(c for c in _input_of(out) if c.startswith("hits"))
    assert "detector" not in field
    got = {r.completion_id: r.text for r in out.collect()}
    assert got == {"a": "mail me at [REDACTED:pii.email] or [REDACTED:pii.email] please", "b": texts[1][1], "c": "x"}


def _input_of(out):
    """The columns that a query's one Python function is given, with their types."""
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().apply(0)
    fields = plan.children().apply(0).schema().fields()
    return [f"{f.name()} {f.dataType().simpleString()}" for f in fields]
