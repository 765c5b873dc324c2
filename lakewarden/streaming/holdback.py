"""Governing text while it is still being produced.

Text arrives in chunks per completion. Every ``every`` new characters it is governed up to its end, and
what lies ``window`` characters behind that end is released.

No text is scanned whole again. A finding depends on what stands within ``reach`` characters of its
start, so each point scans one stretch: the new characters and twice the reach before them. Findings
that start more than the reach before a point are settled there; the others are looked at again with
the next stretch. A point is decided by the labels settled so far and those of its own stretch. What
is kept of an answer is its open end: text, edits and released characters from the first place on
that can still change. All of it is linear in the text.

Three steps: a stateful one that cuts the stretches, the ordinary JVM scan and decision over them,
and a stateful one that releases; labels are carried along in between. The first and last hold one
completion's open end; the costly middle is stateless and spreads freely. State is a table per
micro-batch of the answers still open, read along with the next one's rows.

``prefixes`` and ``outcomes`` govern every prefix whole, which is quadratic; they say what the rest has
to equal. Two answers differ from theirs, and both are stopped: one with a value longer than the
reach less the context of a finding, and one whose duties for a label change after a value of it was
settled.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import redact
from lakewarden.streaming.runs import Kept, each_batch_keeping, folded

# Characters held back, and new characters between governing.
WINDOW = 1024
EVERY = 512
#: Characters on either side of a finding's start that decide it; a value must be shorter, less its context.
REACH, CONTEXT = 512, 48
OVERRUN = "a value longer than the streaming window was found"

STRETCH = "completion_id string, step int, at int, own int, since int, seen int, settled_to int, tail string, final boolean"
_ANSWER_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
LABELLED = f"{STRETCH}, hits_json string, findings array<string>"
_STRETCH = [c.split()[0] for c in STRETCH.split(", ")]
RELEASE = (
    "completion_id string, step int, text string, refusal string, decisions int,"
    " held_back int, overran boolean, final boolean"
)


# --------------------------------------------------------------------------- as a batch


def _points(chunks: DataFrame, every: int) -> DataFrame:
    """``(completion_id, text, points)`` of whole answers; a point is a number of characters at which enough has been added."""
    listed = chunks.groupBy("completion_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("c")
    )
    text = F.array_join(F.transform("c", lambda c: c["delta"]), "")
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("points"))

    def step(s, c):
        seen = s["seen"] + F.length(c["delta"])
        due = seen - s["at"] >= every
        return F.struct(
            seen.alias("seen"),
            F.when(due, seen).otherwise(s["at"]).alias("at"),
            F.when(due, F.array_append(s["points"], seen)).otherwise(s["points"]).alias("points"),
        )

    points = F.aggregate("c", start, step, lambda s: s["points"])
    return listed.select("completion_id", text.alias("text"), points.alias("points"))


def prefixes(chunks: DataFrame, every: int = EVERY) -> DataFrame:
    """All prefixes of chunks ``(completion_id, seq, delta)`` at their points, and the whole."""
    marks = F.transform("points", lambda p, i: F.struct((i + 1).alias("step"), p.alias("at"), F.lit(False).alias("final")))
    last = F.struct((F.size("points") + 1).alias("step"), F.length("text").alias("at"), F.lit(True).alias("final"))
    each = _points(chunks, every).select("completion_id", "text", F.explode(F.concat(marks, F.array(last))).alias("m"))
    return each.select(
        "completion_id",
        F.col("m.step").alias("step"),
        F.left("text", F.col("m.at")).alias("prefix"),
        F.col("m.final").alias("final"),
        F.col("m.at").alias("seen"),
    )


def stretches(chunks: DataFrame, every: int = EVERY, reach: int = REACH) -> DataFrame:
    """What to scan of chunks ``(completion_id, seq, delta)`` at each point and at the end, all at once.

    ``tail`` is the text from ``at`` to ``seen``, new from ``since`` on. Findings that start at ``own``
    or later are the row's own, those that start before ``settled_to`` will not change any more.
    """
    def stretch(seen: Column, since: Column, step: Column, final: bool) -> Column:
        own = F.greatest(F.lit(0), since - reach)
        at = F.greatest(F.lit(0), own - reach)
        return F.struct(
            step.alias("step"),
            at.alias("at"),
            own.alias("own"),
            since.alias("since"),
            seen.alias("seen"),
            F.greatest(F.lit(0), seen - reach).alias("settled_to"),
            F.substring("text", at + 1, seen - at).alias("tail"),
            F.lit(final).alias("final"),
        )

    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("points", i))
    many = F.size("points")
    marks = F.transform("points", lambda p, i: stretch(p, before(i), i + 1, False))
    # Cut before they become rows, so that no row carries the whole text.
    each = F.concat(marks, F.array(stretch(F.length("text"), before(many), many + 1, True)))
    return _points(chunks, every).select("completion_id", F.explode(each).alias("m")).select("completion_id", "m.*")


def hits(scanned: DataFrame, found: str) -> DataFrame:
    """Stretches with ``hits``, the row's own findings among those of its ``tail``, at their places in the answer."""
    own = F.filter(found, lambda f: f["start"] + F.col("at") >= F.col("own"))
    placed = F.transform(own, lambda f: f.withField("start", f["start"] + F.col("at")).withField("end", f["end"] + F.col("at")))
    return scanned.withColumn("hits", placed).drop(found)


def with_labels(found: DataFrame) -> DataFrame:
    """Stretches with ``findings``, the labels settled at earlier points and those of the row itself."""
    settled = F.transform(F.filter("hits", lambda f: f["start"] < F.col("settled_to")), lambda f: f["label"])
    earlier = Window.partitionBy("completion_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    # Stretches without a settled finding add nothing to the list, and there are as many labels as detectors know.
    known = F.flatten(F.collect_list(F.when(F.size(settled) > 0, F.array_distinct(settled))).over(earlier))
    own = F.transform("hits", lambda f: f["label"])
    return found.withColumn("findings", F.array_sort(F.array_distinct(F.concat(known, own))))


def ways(obligations: Column, findings: Column) -> Column:
    """How the redactions among ``obligations`` treat each label; what settled text was rewritten by."""

    def how(label: Column) -> Column:
        rule = redact.rule_for(obligations, label)
        return F.coalesce(F.to_json(F.struct(rule["strategy"].alias("s"), rule["keep_last"].alias("k"), rule["hash_length"].alias("h"))), F.lit("{}"))

    return F.transform(findings, lambda x: F.concat(x, F.lit(" "), how(x)))


class Answer:
    """The open end of one answer, and what was released of it."""

    def __init__(self, window: int, reach: int, state: dict[str, Any] | None = None) -> None:
        self.window, self.reach = window, reach
        # Places in the text are counted from its beginning, as is what was ``sent``; ``made`` governed
        # characters stand before ``base``, where the open text begins.
        self.s = state or {"base": 0, "made": 0, "sent": 0, "open": "", "out": "", "edits": [], "ways": {}, "decisions": 0, "stopped": False}

    def step(self, row: Any) -> tuple[str, str | None, int, int, bool] | None:
        """``(text, refusal, decisions, held back, overran)`` at one point, None after a stop."""
        s = self.s
        if s["stopped"]:
            return None
        s["open"] += row.tail[row.since - row.at :]
        s["decisions"] += 1
        held = max(0, row.seen - s["sent"]) if row.final else 0
        refusal = row.refusal if isinstance(row.refusal, str) else None
        text, overran = "", False
        if refusal is None:
            now = dict(w.split(" ", 1) for w in row.ways)
            own = sorted((e["start"], e["end"], e["replacement"]) for e in row.edits)
            edits = [*map(tuple, s["edits"]), *own]
            governed = self._governed(edits)
            overran = any(now.get(label) != way for label, way in s["ways"].items()) or not governed.startswith(s["out"])
            closed = [h for h in row.hits if h["start"] < row.settled_to]
            overran = overran or any(h["end"] - h["start"] > self.reach - CONTEXT for h in closed)
            if not overran:
                total = s["made"] + len(governed)
                end = total if row.final else total - self.window
                if end > s["sent"]:
                    text, s["sent"] = governed[s["sent"] - s["made"] : end - s["made"]], end
                s["out"] = governed[: s["sent"] - s["made"]]
                s["ways"] |= {h["label"]: now.get(h["label"]) for h in closed}
                s["edits"] = [e for e in edits if e[0] < row.settled_to]
                self._advance(row.settled_to)
        s["stopped"] = refusal is not None or overran
        return text, refusal or (OVERRUN if overran else None), s["decisions"], held, overran

    def _governed(self, edits: list[tuple[int, int, str]]) -> str:
        base, text = self.s["base"], self.s["open"]
        pieces, at = [], base
        for start, end, replacement in edits:
            pieces += [text[at - base : start - base], replacement]
            at = end
        return "".join([*pieces, text[at - base :]])

    def _advance(self, to: int) -> None:
        """Move the base over what is both settled and released, up to ``to`` and never into an edit."""
        s = self.s
        base, made = s["base"], s["made"]
        for start, end, replacement in [*s["edits"], (to, to + 1, "")]:
            plain = min(start - base, to - base, s["sent"] - made)
            if plain > 0:
                base, made = base + plain, made + plain
            if base < start or end > to or made + len(replacement) > s["sent"]:
                break
            base, made = end, made + len(replacement)
        s["open"], s["out"] = s["open"][base - s["base"] :], s["out"][made - s["made"] :]
        s["edits"] = [e for e in s["edits"] if e[0] >= base]
        s["base"], s["made"] = base, made


def answers(judged: DataFrame, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """What each completion delivered, from stretches with ``hits``, ``edits``, ``ways`` and ``refusal``: the columns of ``outcomes``."""

    names = ["completion_id", "text", "refusal", "decisions", "held_back", "overran"]
    kind = judged.schema["completion_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Stretches come sorted, so one answer is open at a time, across batches too.
        open_id, answer, pieces, last = None, None, [], ()
        schema = None

        def table(made: list[tuple]) -> pa.RecordBatch:
            lists = [*zip(*made, strict=True)] or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(lists, schema, strict=True)], schema=schema)

        for batch in batches:
            made = []
            schema = pa.schema([batch.schema.field("completion_id"), *((n, t) for n, t in zip(names[1:], _ANSWER_TYPES, strict=True))])
            # By columns, which spares a dictionary per row.
            for row in map(stretch, *(c.to_pylist() for c in batch.columns)):
                if answer is None or row.completion_id != open_id:
                    if answer is not None:
                        made.append((open_id, "".join(pieces), *last))
                    open_id, answer, pieces = row.completion_id, Answer(window, reach), []
                if (one := answer.step(row)) is not None:
                    pieces.append(one[0])
                    last = one[1:]
            yield table(made)
        if answer is not None:
            yield table([(open_id, "".join(pieces), *last)])

    def thin(items: str, *fields: str) -> Column:
        return F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in fields])).alias(items)

    # Python gets what a step reads of a finding and of an edit, and nothing else.
    read = {"hits": thin("hits", "start", "end", "label"), "edits": thin("edits", "start", "end", "replacement")}
    columns = ["completion_id", "step", "at", "since", "seen", "settled_to", "tail", "final", "hits", "edits", "ways", "refusal"]
    stretch = namedtuple("Stretch", columns)
    ordered = judged.select(*[read.get(c, F.col(c)) for c in columns]).repartition("completion_id").sortWithinPartitions("completion_id", "step")
    return ordered.mapInArrow(fold, f"completion_id {kind}, text string, refusal string, decisions int, held_back int, overran boolean")


def outcomes(governed: DataFrame, window: int = WINDOW) -> DataFrame:
    """What each completion delivered, from governed prefixes ``(..., governed, refusal)``.

    One row per completion: released text, refusal, decisions made, characters held back at
    the end, and whether governance rewrote something already sent.
    """
    order = Window.partitionBy("completion_id").orderBy("step")
    safe = F.when(F.col("final"), F.length("governed")).otherwise(
        F.greatest(F.lit(0), F.length("governed") - window)
    )
    staged = governed.withColumn("safe", safe)
    # Governed prefixes only ever agree on what was released, or the stream stops; so the text
    # out so far is the longest safe part yet.
    staged = staged.withColumn(
        "sent", F.max(F.struct("safe", F.left("governed", F.col("safe")).alias("text"))).over(
            order.rowsBetween(Window.unboundedPreceding, -1)
        )
    )
    sent = F.coalesce("sent.text", F.lit(""))
    broken = F.col("refusal").isNull() & ~F.startswith(F.col("governed"), sent)
    staged = staged.withColumn("stop", F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(broken, F.lit(OVERRUN)))
    staged = staged.withColumn("overran", broken & F.col("refusal").isNull())
    first = F.min(F.when(F.col("stop").isNotNull(), F.col("step"))).over(Window.partitionBy("completion_id"))
    live = staged.withColumn("stop_at", first).where(F.col("stop_at").isNull() | (F.col("step") <= F.col("stop_at")))
    stopped = F.max(F.struct("step", "stop", "overran", F.coalesce("sent.text", F.lit("")).alias("sent"), "governed", "seen", F.col("final").alias("final")))
    return live.groupBy("completion_id").agg(F.count("*").cast("int").alias("decisions"), stopped.alias("l")).select(
        "completion_id",
        F.when(F.col("l.stop").isNotNull(), F.col("l.sent")).otherwise(F.col("l.governed")).alias("text"),
        F.col("l.stop").alias("refusal"),
        "decisions",
        F.when(F.col("l.final"), F.greatest(F.lit(0), F.col("l.seen") - F.length("l.sent"))).otherwise(F.lit(0)).alias("held_back"),
        F.col("l.overran").alias("overran"),
    )


def buffered(chunks: DataFrame, govern: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The other mode: collect everything, then decide once."""
    whole = prefixes(chunks, every=1 << 30)
    return govern(whole).select("completion_id", F.when(F.col("refusal").isNull(), F.col("governed")).alias("text"), "refusal")


# --------------------------------------------------------------------------- as a stream


class _Cut:
    """Cuts the stretches of an answer; remembers the text that the next one begins with."""

    def __init__(self, every: int, reach: int, state: str | None) -> None:
        self._every, self._reach, self._done = every, reach, False
        self._s = json.loads(state) if state else ("", 0, 0, 0)

    def take(self, row: Any) -> list[tuple]:
        tail, at, since, step = self._s
        tail += row.delta
        out = []
        for final in [False] * (at + len(tail) - since >= self._every) + [True] * row.is_last:
            seen, own, step = at + len(tail), max(0, since - self._reach), step + 1
            settled_to = max(0, seen - self._reach)
            out.append((row.completion_id, step, at, own, since, seen, settled_to, tail, final))
            since, start = seen, max(0, settled_to - self._reach)
            tail, at = tail[start - at :], start
        self._s = (tail, at, since, step)
        self._done = self._done or row.is_last
        return out

    def left(self) -> str | None:
        return None if self._done else json.dumps(self._s)


class _Label:
    """Adds the labels settled at earlier points to each stretch; remembers labels only."""

    def __init__(self, state: str | None) -> None:
        self._known = set(json.loads(state)) if state else set()
        self._done = False

    def take(self, row: Any) -> list[tuple]:
        own = json.loads(row.hits_json)
        known = sorted(self._known | {h["label"] for h in own})
        self._known |= {h["label"] for h in own if h["start"] < row.settled_to}
        self._done = self._done or row.final
        return [(*(getattr(row, n) for n in _STRETCH), row.hits_json, known)]

    def left(self) -> str | None:
        return None if self._done else json.dumps(sorted(self._known))


class _Release:
    """Releases what is safely behind the governed end, and stops at a refusal; remembers the open end."""

    def __init__(self, window: int, reach: int, state: str | None) -> None:
        self._answer, self._done = Answer(window, reach, json.loads(state) if state else None), False

    def take(self, row: Any) -> list[tuple]:
        self._done = self._done or row.final
        made = self._answer.step(row)
        return [] if made is None else [(row.completion_id, row.step, *made, row.final)]

    def left(self) -> str | None:
        return None if self._done else json.dumps(self._answer.s)


def released(
    chunks: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    every: int = EVERY,
    window: int = WINDOW,
    reach: int = REACH,
) -> DataFrame:
    """Governed output of a chunk stream ``(completion_id, seq, delta, is_last)``, run to its end.

    ``find`` adds ``hits`` to stretches, ``judge`` adds ``refusal``, ``edits`` and ``ways`` to those with
    ``hits`` and ``findings``; both are the same batch code.
    """

    def job(batch: DataFrame, kept: Kept) -> tuple[DataFrame, Kept]:
        def through(rows: DataFrame, name: str, order: str, begin: Callable[[str | None], Any], schema: str) -> tuple[DataFrame, DataFrame]:
            return folded(rows, kept.get(name), "completion_id", [F.col(order)], begin, schema)

        cut_up, texts = through(batch, "texts", "seq", lambda s: _Cut(every, reach, s), STRETCH)
        found = find(cut_up)
        kind = found.schema["hits"].dataType.simpleString()
        spelled = found.select(*_STRETCH, F.to_json("hits").alias("hits_json"))
        labelled, labels = through(spelled, "labels", "step", _Label, LABELLED)
        judged = judge(labelled.withColumn("hits", F.from_json("hits_json", kind)).drop("hits_json"))
        made, answers = through(judged.select(*_STRETCH, "hits", "edits", "ways", "refusal"), "answers", "step", lambda s: _Release(window, reach, s), RELEASE)
        return made, {"texts": texts, "labels": labels, "answers": answers}

    return each_batch_keeping(chunks, "released", RELEASE, job)[0]


def delivered(pieces: DataFrame) -> DataFrame:
    """Released pieces put together per completion, in the shape of ``outcomes``."""
    listed = F.array_sort(F.collect_list(F.struct("step", "text")))
    return pieces.groupBy("completion_id").agg(
        F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"),
        F.max("refusal").alias("refusal"),
        F.max("decisions").alias("decisions"),
        F.max("held_back").alias("held_back"),
        F.max("overran").alias("overran"),
    )
