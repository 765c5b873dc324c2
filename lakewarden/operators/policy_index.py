"""Policy sets held as tables: any number of policies or versions, matched by joins.

``policy.evaluate`` makes one Column of each policy, which suits tens of them. Here a policy is a row.
Its match tree becomes clauses: it matches where all tests of one clause hold. Every clause is posted
under one of its equality tests, the one that the fewest requests pass, and under the pieces of its
span of time; requests look up their own values there. What meets is tested in full. The plan has the
same size for one policy and for a million. Dated versions of which few hold at a time are met as lists
of their time instead, each tree tested once for all its versions.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import conditions as C
from lakewarden.operators import obligations as O
from lakewarden.operators import policy
from lakewarden.session import cut

_OPERAND = "struct<text:string,number:double,flag:boolean,empty:boolean,pattern:string>"
_TEST = f"struct<selector:string,operator:string,negated:boolean,listed:boolean,operands:array<{_OPERAND}>>"
_COMPILED = f"struct<fault:string,clauses:array<struct<tests:array<{_TEST}>>>>"
_FEATURE = "struct<present:boolean,is_null:boolean,is_list:boolean,count:int,strings:array<string>,numbers:array<double>,booleans:array<boolean>>"
#: Spelled as another operator, negated or not.
_SAME_AS = {"neq": ("eq", True), "any_of": ("in", False), "not_in": ("in", True), "none_of": ("in", True), "not_glob": ("glob", True)}
_OF_NUMBERS, _OF_FLAGS = ("gt", "gte", "lt", "lte", "count_gte", "count_lte"), ("exists", "empty")
#: Levels of blocks of time where all clauses hold always.
_LEVELS = 24
#: A slot is at most an hour, and the time that requests span is cut into at most so many.
_LONGEST, _SLOTS = 3600, 1 << 18
#: A list of versions has at most so many, under so many trees; the time asked about is cut into so many slots, at least and at most.
_LISTED, _TREES, _LIST_SLOTS = 1024, 256, (1 << 12, 1 << 22)
#: Trees that are copied to every task; more of them are joined by merging.
_COPIED = 4096


# --------------------------------------------------------------------------- documents to clauses


def _operand(value: Any, operator: str) -> dict[str, Any]:
    text = value if isinstance(value, str) else None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "text": text,
        "number": float(value) if number else None,
        "flag": value if isinstance(value, bool) else None,
        "empty": value is None,
        "pattern": text if operator == "regex" else C.glob_regex(text) if operator == "glob" and text is not None else None,
    }


def _tests(selector: str, raw: Any) -> list[dict[str, Any]]:
    if selector.split(".")[0] not in C.ROOTS:
        raise C.PolicyError(f"selector {selector!r} must start with one of {', '.join(sorted(C.ROOTS))}")
    checks = policy.sugar(raw)
    if not checks:
        raise C.PolicyError(f"selector {selector!r} has no operators")
    out = []
    for name, value in checks.items():
        # Operands are refused as ``conditions.condition`` refuses them.
        if name not in C.OPERATORS:
            raise C.PolicyError(f"unknown operator {name!r}; known operators: {', '.join(sorted(C.OPERATORS))}")
        if name in _OF_NUMBERS and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise C.PolicyError(f"operator {name!r} needs a number, got {type(value).__name__}")
        if name in _OF_FLAGS and not isinstance(value, bool):
            raise C.PolicyError(f"operator {name!r} needs a boolean operand")
        if name == "regex":
            C.check_pattern(value)
        operator, negated = _SAME_AS.get(name, (name, False))
        listed = isinstance(value, (list, tuple))
        out.append(
            {
                "selector": selector,
                "operator": operator,
                "negated": negated,
                "listed": listed,
                "operands": [_operand(x, operator) for x in (value if listed else [value])],
            }
        )
    return out


def _both(parts: Iterable[list[list[dict]]]) -> list[list[dict]]:
    return [[t for clause in choice for t in clause] for choice in itertools.product(*parts)]


def _negated(clauses: list[list[dict]]) -> list[list[dict]]:
    return _both([[{**t, "negated": not t["negated"]}] for t in clause] for clause in clauses)


def clauses(node: Mapping[str, Any] | None) -> list[list[dict[str, Any]]]:
    """A match tree as alternatives of tests that hold together; the same trees as ``policy.compile_match``."""
    if not node:
        return [[]]
    if not isinstance(node, Mapping):
        raise C.PolicyError(f"a match node must be an object, got {type(node).__name__}")
    shape = {"all", "any", "not", "conditions"} & set(node)
    if not shape:
        return [[t for s, raw in node.items() for t in _tests(str(s), raw)]]
    if len(node) > 1:
        raise C.PolicyError(f"a match node sets {', '.join(sorted(map(str, node)))} side by side")
    kind = shape.pop()
    if kind == "conditions":
        return [[t for s, raw in node[kind].items() for t in _tests(str(s), raw)]]
    if kind == "not":
        return _negated(clauses(node[kind]))
    children = [clauses(child) for child in node[kind]]
    if kind == "all":
        return _both(children)
    return [c for child in children for c in child] if children else [[]]


def _compiled(text: str | None) -> str:
    try:
        return json.dumps({"fault": None, "clauses": [{"tests": c} for c in clauses(json.loads(text) if text else None)]})
    except (C.PolicyError, json.JSONDecodeError) as wrong:
        return json.dumps({"fault": str(wrong), "clauses": []})


def compiled(policies: DataFrame) -> DataFrame:
    """``policies`` (with ``match``, a tree as JSON) plus ``clauses`` and ``fault``.

    A tree that cannot be used has a fault and no clauses, so it matches nothing. A null or empty
    tree matches everything.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = pa.array([_compiled(t) for t in batch.column("match").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "_compiled"])

    schema = policies.withColumn("_compiled", F.lit("")).schema
    done = policies.mapInArrow(run, schema).withColumn("_compiled", F.from_json("_compiled", _COMPILED))
    return done.select(*policies.columns, F.col("_compiled.clauses").alias("clauses"), F.col("_compiled.fault").alias("fault"))


# --------------------------------------------------------------------------- tests as data


def features(requests: DataFrame, selectors: Sequence[str]) -> Column:
    """What each selector resolves to, as a map from its name."""
    held = []
    for selector in selectors:
        view = C.select(requests.schema, selector)
        held.append(F.struct(*[getattr(view, p).alias(p) for p in C.View.PARTS if p != "shown"]).cast(_FEATURE))
    names = F.array(*[F.lit(s) for s in selectors]).cast("array<string>")
    return F.map_from_arrays(names, F.array(*held).cast(f"array<{_FEATURE}>"))


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _is(view: Column, operand: Column, family: bool) -> Column:
    def same(s: Column) -> Column:
        return (s == operand["text"]) | F.startswith(s, F.concat(operand["text"], F.lit("."))) if family else s == operand["text"]

    return (
        _yes(F.exists(view["strings"], same))
        | _yes(F.array_contains(view["numbers"], operand["number"]))
        | _yes(F.array_contains(view["booleans"], operand["flag"]))
        | (operand["empty"] & view["is_null"])
    )


def _some(view: Column, operands: Column, hit) -> Column:
    return F.exists(operands, lambda o: _yes(F.exists(view["strings"], lambda s: _yes(hit(s, o)))))


def holds(features: Column, test: Column) -> Column:
    """Whether one test, a row's value, holds for a request's features. Never null."""
    none = F.array()
    absent = F.struct(*[F.lit(x).alias(n) for n, x in (("present", False), ("is_null", False), ("is_list", False), ("count", 0))], *[none.alias(n) for n in ("strings", "numbers", "booleans")])
    view = F.coalesce(F.try_element_at(features, test["selector"]), absent.cast(_FEATURE))
    # Bound once by the lambda, not spelled out in every case.
    return F.forall(F.array(view), lambda v: _holds(v, test))


def _holds(view: Column, test: Column) -> Column:
    operands, first = test["operands"], F.get(test["operands"], F.lit(0))
    texts = F.transform(operands, lambda o: o["text"])
    same_list = view["is_list"] & F.forall(texts, lambda t: t.isNotNull()) & (view["strings"] == texts) & (view["count"] == F.size(operands))
    equal = view["present"] & F.when(test["listed"], same_list).otherwise(~view["is_list"] & _is(view, first, False))

    def number(compare) -> Column:
        return F.exists(view["numbers"], lambda n: _yes(compare(n, first["number"])))

    cases = {
        "eq": equal,
        "in": F.exists(operands, lambda o: _is(view, o, True)),
        "all_of": (view["count"] > 0) & F.forall(operands, lambda o: _is(view, o, True)),
        "glob": _some(view, operands, lambda s, o: F.regexp_like(s, o["pattern"])),
        "regex": _some(view, operands, lambda s, o: F.regexp_like(s, o["pattern"])),
        "contains": _some(view, operands, lambda s, o: F.contains(s, o["text"])),
        "startswith": _some(view, operands, lambda s, o: F.startswith(s, o["text"])),
        "endswith": _some(view, operands, lambda s, o: F.endswith(s, o["text"])),
        "exists": (view["present"] & ~view["is_null"]) == first["flag"],
        "empty": (view["count"] == 0) == first["flag"],
        "gt": number(lambda a, b: a > b),
        "gte": number(lambda a, b: a >= b),
        "lt": number(lambda a, b: a < b),
        "lte": number(lambda a, b: a <= b),
        "count_gte": view["count"] >= first["number"],
        "count_lte": view["count"] <= first["number"],
    }
    chosen = F.lit(False)
    # The first of them is asked first.
    for name, case in reversed(cases.items()):
        chosen = F.when(test["operator"] == name, _yes(case)).otherwise(chosen)
    return chosen != test["negated"]


# --------------------------------------------------------------------------- index


def atoms(features: Column) -> Column:
    """``(selector, atom)`` under which a request looks up clauses: its strings and their dotted ancestors."""

    def ancestors(text: Column) -> Column:
        steps = F.split(text, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))

    per = F.transform(
        F.map_entries(features),
        lambda e: F.transform(F.flatten(F.transform(e["value"]["strings"], ancestors)), lambda a: F.struct(e["key"].alias("selector"), a.alias("atom"))),
    )
    anywhere = F.array(F.struct(F.lit("").alias("selector"), F.lit("").alias("atom")))
    return F.array_distinct(F.concat(F.flatten(per), anywhere))


def pieces(first: Column, last: Column, levels: int = _LEVELS) -> Column:
    """``(level, at)`` of the fewest aligned blocks of 2^level slots that cover slots ``first`` up to before ``last``."""
    start = F.struct(first.cast("long").alias("lo"), last.cast("long").alias("hi"), F.array().cast("array<struct<level:int,at:bigint>>").alias("out"))

    def step(held: Column, level: Column) -> Column:
        lo, hi, out = held["lo"], held["hi"], held["out"]
        left, right = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
        block = lambda at: F.struct(level.alias("level"), at.alias("at"))
        more = F.array_compact(F.array(F.when(left, block(lo)), F.when(right & ~(left & (lo == hi - 1)), block(hi - 1))))
        return F.struct(
            F.floor((lo + left.cast("int")) / 2).cast("long").alias("lo"),
            F.floor((hi - right.cast("int")) / 2).cast("long").alias("hi"),
            F.concat(out, more).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda held: held["out"])


def _postings(policies: DataFrame, asked: DataFrame) -> DataFrame:
    """Clauses as ``(policy, clause, tests, since, until, covered, selector, atom)``, each under its rarest equality test.

    A clause without one is posted under the empty atom, which every request looks up.
    """
    rows = policies.select("policy", "since", "until", "covered", F.posexplode("clauses").alias("clause", "c")).withColumn("tests", F.col("c.tests")).drop("c")
    equal = F.filter(
        "tests",
        lambda t: ~t["negated"]
        & ((t["operator"] == "in") | ((t["operator"] == "eq") & ~t["listed"]))
        & (F.size(t["operands"]) > 0)
        & F.forall(t["operands"], lambda o: o["text"].isNotNull()),
    )
    anchors = rows.select("policy", "clause", F.posexplode(equal).alias("turn", "t")).select(
        "policy", "clause", "turn", F.col("t.selector").alias("selector"), F.explode(F.array_distinct(F.transform("t.operands", lambda o: o["text"]))).alias("atom")
    )
    cost = anchors.join(asked, ["selector", "atom"], "left").groupBy("policy", "clause", "turn").agg(F.sum(F.coalesce("many", F.lit(0))).alias("cost"))
    rarest = cost.groupBy("policy", "clause").agg(F.min_by("turn", F.struct("cost", "turn")).alias("turn"))
    # Merged, as the planner judges clauses by the file of their policies and would copy them through the driver.
    under = anchors.join(rarest.hint("merge"), ["policy", "clause", "turn"]).drop("turn")
    free = rows.where(F.size(equal) == 0).select("policy", "clause", F.lit("").alias("selector"), F.lit("").alias("atom"))
    return rows.join(under.unionByName(free).hint("merge"), ["policy", "clause"])


def _times(asking: DataFrame, policies: DataFrame, grain: int | None) -> tuple[int, int, int]:
    """First and last second that requests ask about, and how long a slot should be.

    A slot much longer than the spans of policies would make every request meet all versions that came
    and went within it, so it is half the median span inside the time asked about.
    """
    asked = F.unix_seconds(F.col("time").cast("timestamp"))
    first, last = asking.agg(F.min(asked), F.max(asked)).first()
    if first is None:
        return 0, 0, grain or _LONGEST
    if grain is None:
        since = F.greatest(F.coalesce(F.unix_seconds(F.col("valid_from").cast("timestamp")), F.lit(first)), F.lit(first))
        until = F.least(F.coalesce(F.unix_seconds(F.col("valid_to").cast("timestamp")), F.lit(last)), F.lit(last))
        median = policies.select((until - since).alias("n")).where("n >= 0").agg(F.percentile_approx("n", 0.5)).first()[0]
        grain = max(1, min(_LONGEST, (_LONGEST if median is None else median) // 2), (last - first) // _SLOTS)
    return first, last, grain


def matches(requests: DataFrame, policies: DataFrame, selectors: Sequence[str], id_col: str = "request_id", at: str | None = None, grain: int | None = None) -> DataFrame:
    """``(request id, policy)``: which of the ``compiled`` policies match each request.

    ``policy`` identifies a row of ``policies`` and ``id_col`` one of ``requests``. A test on a selector
    that is not listed sees an absent value. With ``at``, the column of a request's time, a policy counts
    from ``valid_from`` (null: always) to before ``valid_to`` (null: ever after); a request without a time
    matches nothing then. ``grain`` is the length of a slot in seconds, by default chosen from the spans; it
    changes the work, not the result.
    """
    asking = requests.select(F.col(id_col), features(requests, selectors).alias("features"), (F.col(at) if at else F.lit(None).cast("timestamp")).alias("time"))
    always = F.lit(None).cast("timestamp")
    if at:
        asking = asking.where("time is not null")
        # Times outside those asked about share the slots at the ends.
        first, end, grain = _times(asking, policies, grain)
        last = (end - first) // grain

        def slot(time: Column) -> Column:
            return F.least(F.greatest(F.floor((F.unix_seconds(time.cast("timestamp")) - first) / grain), F.lit(0)), F.lit(last))

        asking = asking.withColumn("slot", slot(F.col("time")))
        since, until = F.col("valid_from").cast("timestamp"), F.col("valid_to").cast("timestamp")
        covered = pieces(F.when(since.isNull(), 0).otherwise(slot(since)), F.when(until.isNull(), last + 1).otherwise(slot(until) + 1), (last + 1).bit_length())
    else:
        asking = asking.withColumn("slot", F.lit(0))
        since, until, covered = always, always, pieces(F.lit(0), F.lit(1 << _LEVELS))
    # Read several times: written once, or every match tree would be compiled anew each time.
    valid = cut(policies.withColumn("since", since).withColumn("until", until).withColumn("covered", covered), "clauses")
    looked = asking.select("*", F.explode(atoms(F.col("features"))).alias("a")).select(id_col, "features", "time", "slot", "a.selector", "a.atom")
    asked = asking.select(F.explode(atoms(F.col("features"))).alias("a")).groupBy("a.selector", "a.atom").agg(F.count("*").alias("many"))
    posts = cut(_postings(valid, asked).select("*", F.explode("covered").alias("piece")).select("policy", "tests", "since", "until", "selector", "atom", "piece.level", "piece.at"), "postings")
    # Requests are spread over those levels only that clauses of their value have.
    levels = posts.groupBy("selector", "atom").agg(F.collect_set("level").alias("levels"))
    probes = looked.join(levels, ["selector", "atom"]).select(id_col, "features", "time", "slot", "selector", "atom", F.explode("levels").alias("level"))
    probes = probes.withColumn("at", F.expr("shiftright(cast(slot as bigint), level)")).drop("slot")
    inside = F.coalesce(F.col("time") >= F.col("since"), F.lit(True)) & F.coalesce(F.col("time") < F.col("until"), F.lit(True))
    met = probes.join(posts, ["selector", "atom", "level", "at"]).where(inside)
    return met.where(F.forall("tests", lambda t: holds(F.col("features"), t))).select(id_col, "policy").distinct()


def kinds(policies: DataFrame, entry: Column) -> tuple[DataFrame, DataFrame]:
    """``(kind, entry)`` of every policy, and ``(policy, match)`` of one policy per kind: those with the same trees."""
    tree = F.coalesce("match", F.lit(""))
    named = policies.where("policy is not null").groupBy("policy").agg(F.sort_array(F.collect_set(tree)).alias("trees"), F.collect_list(entry).alias("entries"))
    one = cut(named.groupBy("trees").agg(F.min("policy").alias("kind")), "kinds")
    members = named.join(one, "trees").select("kind", F.explode("entries").alias("entry"))
    return members, one.select(F.col("kind").alias("policy"), F.explode("trees").alias("match"))


def evaluate(
    requests: DataFrame,
    policies: DataFrame,
    selectors: Sequence[str],
    algorithm: str = "deny_overrides",
    default_effect: str = policy.DENY,
    id_col: str = "request_id",
    at: str | None = None,
    grain: int | None = None,
) -> DataFrame:
    """Decide requests against a table of policies; what ``policy.evaluate`` and ``policy.replay`` do for lists.

    ``policies`` holds ``policy`` (unique), ``key``, ``name``, ``priority``, ``effect``, ``match`` (JSON),
    ``obligations`` (in the column's own shape) and, for ``at``, ``valid_from`` and ``valid_to``. Adds
    effect, determining_policy, matched_policies and obligations to every request.
    """
    if algorithm not in policy.ALGORITHMS:
        raise C.PolicyError(f"unknown algorithm {algorithm!r}")
    entry = F.struct(
        (-F.col("priority")).alias("order"), "key", F.coalesce("name", "key").alias("name"), F.col("priority").cast("int").alias("priority"), "effect",
        F.coalesce(F.col("obligations"), F.array().cast(O.OBLIGATIONS)).alias("obligations"),
    )
    if at:
        return _replayed(requests, policies, entry, selectors, algorithm, default_effect, id_col, at, grain)
    # Dated versions seldom share their span; policies that test the same are matched as one.
    members, trees = kinds(policies, entry)
    return _by_sets(requests, matches(requests, compiled(trees), selectors, id_col), members, algorithm, default_effect, id_col)


def _by_sets(requests: DataFrame, found: DataFrame, members: DataFrame, algorithm: str, default_effect: str, id_col: str) -> DataFrame:
    """``requests`` decided by ``found``, their ``(request id, policy)``; ``members`` are the entries of each policy."""
    # Read twice. Requests that match the same are settled as one, so the lists are as many as the sets that occur.
    sets = cut(found.where("policy is not null").groupBy(id_col).agg(F.sort_array(F.collect_list("policy")).alias("_set")), "sets")
    settled = (
        sets.select("_set").distinct().select("_set", F.explode("_set").alias("kind"))
        .join(members, "kind")
        .groupBy("_set")
        .agg(F.sort_array(F.collect_list("entry")).alias("_matched"))
        .withColumn("_winner", policy.combine(F.col("_matched"), algorithm))
        .withColumn("_effect", F.coalesce(F.col("_winner.effect"), F.lit(default_effect)))
        .select(
            "_set", "_effect", F.col("_winner.key").alias("_key"), F.transform("_matched", lambda m: m["key"]).alias("_keys"),
            policy.duties(F.col("_matched"), F.col("_effect")).alias("_duties"), F.lit(0).cast("long").alias("_part"),
        )
    )
    # Joined last, so that no list is moved once per request; requests that match nothing are spread.
    asked = requests.join(sets, id_col, "left").withColumn("_part", F.when(F.col("_set").isNull(), F.xxhash64(id_col)).otherwise(0))
    return (
        asked.join(settled, ["_set", "_part"], "left")
        .withColumn("effect", F.coalesce("_effect", F.lit(default_effect)))
        .withColumn("determining_policy", F.col("_key"))
        .withColumn("matched_policies", F.coalesce("_keys", F.array().cast("array<string>")))
        .withColumn("obligations", F.coalesce("_duties", F.array().cast(O.OBLIGATIONS)))
        .drop("_set", "_part", "_effect", "_key", "_keys", "_duties")
    )


# --------------------------------------------------------------------------- versions as lists


def _in_force(groups: Column, features: Column, time: Column) -> Column:
    """Entries of all versions that hold at a time and match: of ``(clauses, spans)``, spans being ``(since, until, entry)``."""

    def matching(asked: Column) -> Column:
        held = F.transform(
            groups,
            lambda g: F.struct(
                g["clauses"].alias("clauses"),
                F.filter(g["spans"], lambda s: (s["since"] <= asked["time"]) & (asked["time"] < s["until"])).alias("spans"),
            ),
        )
        hit = F.filter(held, lambda g: (F.size(g["spans"]) > 0) & F.exists(g["clauses"], lambda c: F.forall(c["tests"], lambda t: holds(asked["features"], t))))
        return F.flatten(F.transform(hit, lambda g: F.transform(g["spans"], lambda s: s["entry"])))

    # Bound once by the lambda, as the features are read by every test.
    return F.transform(F.array(F.struct(features.alias("features"), time.alias("time"))), matching)[0]


def _trees(dated: DataFrame) -> DataFrame:
    """``(tree, match, clauses)`` of every tree of ``dated`` that can match, each compiled once."""
    made = compiled(dated.select("match").distinct()).where(F.size("clauses") > 0)
    return cut(made.select(F.monotonically_increasing_id().alias("tree"), "match", "clauses"), "trees")


def _replayed(
    requests: DataFrame, policies: DataFrame, entry: Column, selectors: Sequence[str], algorithm: str, default_effect: str, id_col: str, at: str, grain: int | None
) -> DataFrame:
    """Requests against dated versions: time is cut into slots, and a request meets the list of its slot.

    A slot is as long as a version holds on average, so its list is about twice what holds at a time. Requests
    whose slot has too long a list or too many trees, and those that share an id, look versions up by value instead.
    """

    def looked_up(asked: DataFrame) -> DataFrame:
        found = matches(asked, compiled(policies), selectors, id_col, at, grain)
        return _by_sets(asked, found, policies.select(F.col("policy").alias("kind"), entry.alias("entry")), algorithm, default_effect, id_col)

    def micros(time: str) -> Column:
        return F.unix_micros(F.col(time).cast("timestamp"))

    per_id = requests.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"), F.min(micros(at)).alias("lo"), F.max(micros(at)).alias("hi"))
    first, last, most, asking = per_id.agg(F.min("lo"), F.max("hi"), F.max("n"), F.sum("n")).first()
    if first is None:
        return looked_up(requests)
    dated = cut(
        policies.where("policy is not null").select("policy", F.coalesce("match", F.lit("")).alias("match"), entry.alias("entry"), micros("valid_from").alias("since"), micros("valid_to").alias("until")),
        "dated",
    )
    if dated.groupBy("policy").count().agg(F.max("count")).first()[0] != 1:
        return looked_up(requests)
    begin, end = F.greatest(F.coalesce("since", F.lit(first)), F.lit(first)), F.least(F.coalesce("until", F.lit(last + 1)), F.lit(last + 1))
    dated = dated.withColumn("since", begin).withColumn("until", end).where("since < until")
    span, n = dated.agg(F.avg((F.col("until") - F.col("since")).cast("double")), F.count("*")).first()
    if not n or span * n > _LISTED * (last + 1 - first):
        return looked_up(requests)
    # No more slots than requests, and never so few that a core is left without.
    longest, shortest = (-(-(last + 1 - first) // slots) for slots in _LIST_SLOTS)
    step = max(min(grain * 1_000_000 if grain else int(span), longest), shortest, (last + 1 - first) // asking)

    def slot(time: Column) -> Column:
        return F.call_function("div", time - F.lit(first), F.lit(step))

    trees = _trees(dated)
    few = trees.count() <= _COPIED
    known = F.broadcast(trees) if few else trees.hint("merge")
    covered = F.explode(F.sequence(slot(F.col("since")), slot(F.col("until") - 1))).alias("_slot")
    cells = dated.join(known.select("tree", "match"), "match").select(covered, "tree", "since", "until", "entry")
    sizes = cells.groupBy("_slot", "tree").agg(F.count("*").alias("n")).groupBy("_slot").agg(F.sum("n").alias("n"), F.count("*").alias("trees"))
    long = cut(sizes.where((F.col("n") > _LISTED) | (F.col("trees") > _TREES)).select("_slot"), "long")
    asked = requests.withColumn("_slot", F.when(F.col(id_col).isNotNull(), slot(micros(at))))
    apart = []
    if most > 1:
        twice = cut(per_id.where("n > 1").select(id_col, F.lit(True).alias("_twice")), "twice")
        asked, apart = asked.join(twice, id_col, "left"), ["_twice"]
    if long.head(1):
        asked, apart = asked.join(long.withColumn("_long", F.lit(True)), "_slot", "left"), [*apart, "_long"]
        cells = cells.join(long, "_slot", "left_anti")
    other = F.coalesce(*[F.col(c) for c in apart], F.lit(False))

    lists = (
        cells.repartition("_slot")
        .groupBy("_slot", "tree")
        .agg(F.collect_list(F.struct("since", "until", "entry")).alias("spans"))
        .join(known.select("tree", "clauses"), "tree")
        .groupBy("_slot")
        .agg(F.collect_list(F.struct("clauses", "spans")).alias("_groups"))
    )
    # Requests that have no slot match nothing and are spread.
    alone = asked.where(~other).withColumn("_slot", F.coalesce("_slot", -1 - F.pmod(F.xxhash64(id_col), F.lit(1 << 20))))
    met = alone.join(lists, "_slot", "left")
    found = _in_force(F.col("_groups"), features(met, selectors), micros(at))
    none = F.array().cast(T.ArrayType(cells.schema["entry"].dataType))
    out = (
        met.withColumn("_matched", F.sort_array(F.coalesce(found, none)))
        .withColumn("_winner", policy.combine(F.col("_matched"), algorithm))
        .withColumn("effect", F.coalesce("_winner.effect", F.lit(default_effect)))
        .withColumn("determining_policy", F.col("_winner.key"))
        .withColumn("matched_policies", F.transform("_matched", lambda m: m["key"]))
        .withColumn("obligations", policy.duties(F.col("_matched"), F.col("effect")))
        .select(*requests.columns, "effect", "determining_policy", "matched_policies", "obligations")
    )
    return out.unionByName(looked_up(asked.where(other).select(*requests.columns))) if apart else out


def faults(policies: DataFrame) -> DataFrame:
    """``(policy, key, fault)`` of policies whose match tree cannot be used."""
    return compiled(policies).where("fault is not null").select("policy", "key", "fault")
