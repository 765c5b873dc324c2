"""Policy sets compiled to Columns: matching, combining, explaining, comparing."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import taxonomy
from lakewarden.operators import conditions as C
from lakewarden.operators import obligations as O
from lakewarden.session import cut

ALLOW, APPROVE, DENY = "allow", "require_approval", "deny"
# Which effect wins first under each algorithm, and how equal priorities rank.
PRECEDENCE = {
    "deny_overrides": (DENY, APPROVE, ALLOW),
    "permit_overrides": (ALLOW, APPROVE, DENY),
}
EFFECT_RANK = {ALLOW: 0, APPROVE: 1, DENY: 2}
ALGORITHMS = (*PRECEDENCE, "priority_ordered")

CONDITION = "struct<selector:string,operator:string,operand:string,observed:string,passed:boolean>"
TRACE = (
    "struct<key:string,name:string,effect:string,priority:int,matched:boolean,"
    f"reason:string,conditions:array<{CONDITION}>>"
)

#: Rows of one side of a pairing that each row of the other meets at a time.
BLOCK = 1024

#: Columns that tests read, by selector and part.
Seen = dict[tuple[str, str], tuple[str, Column]]


@dataclass
class Node:
    """A compiled match tree: whether it holds, each test made, and the first failure."""

    passed: Column
    tests: list[Column] = field(default_factory=list)
    failure: Column | None = None


def _failure(parts: Iterable[Column | None]) -> Column:
    known = [p for p in parts if p is not None]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def sugar(raw: Any) -> dict[str, Any]:
    """A scalar means ``eq``, a list means ``in``."""
    if isinstance(raw, Mapping):
        return dict(raw)
    return {"in": list(raw)} if isinstance(raw, (list, tuple, set, frozenset)) else {"eq": raw}


def _test(schema: T.StructType, selector: str, raw: Any, explain: bool, seen: Seen | None) -> Node:
    if selector.split(".")[0] not in C.ROOTS:
        raise C.PolicyError(f"selector {selector!r} must start with one of {', '.join(sorted(C.ROOTS))}")
    view = C.select(schema, selector)
    if seen is not None:
        view = C.bound(view, selector, seen)
    checks = [(op, operand, C.condition(view, op, operand)) for op, operand in sugar(raw).items()]
    if not checks:
        raise C.PolicyError(f"selector {selector!r} has no operators")
    holds = functools.reduce(lambda a, b: a & b, [c for _, _, c in checks])
    if not explain:
        return Node(holds)
    tests, failures = [], []
    for op, operand, passed in checks:
        tests.append(
            F.struct(
                F.lit(selector).alias("selector"),
                F.lit(op).alias("operator"),
                F.lit(repr(operand)).alias("operand"),
                view.shown.alias("observed"),
                passed.alias("passed"),
            )
        )
        told = F.concat(
            F.lit(f"{selector} {op} {operand!r} did not match (observed "), view.shown, F.lit(")")
        )
        failures.append(F.when(~passed, told))
    return Node(holds, tests, _failure(failures))


def _all(nodes: Sequence[Node], explain: bool) -> Node:
    passed = functools.reduce(lambda a, b: a & b, [n.passed for n in nodes]) if nodes else F.lit(True)
    if not explain:
        return Node(passed)
    failures = [F.when(~n.passed, n.failure) for n in nodes if n.failure is not None]
    return Node(passed, [t for n in nodes for t in n.tests], _failure(failures))


def compile_match(schema: T.StructType, node: Mapping[str, Any] | None, explain: bool = False, seen: Seen | None = None) -> Node:
    """A match tree as Columns over a request table's schema; explaining costs extra Columns.

    With ``seen`` the tests read columns that the caller has to add, see ``conditions.bound``.
    """
    if not node:
        return Node(F.lit(True))
    if not isinstance(node, Mapping):
        raise C.PolicyError(f"a match node must be an object, got {type(node).__name__}")
    shape = {"all", "any", "not", "conditions"} & set(node)
    if not shape:
        return _all([_test(schema, str(s), raw, explain, seen) for s, raw in node.items()], explain)
    if len(node) > 1:
        raise C.PolicyError(f"a match node sets {', '.join(sorted(map(str, node)))} side by side")
    kind = shape.pop()
    if kind == "conditions":
        return _all([_test(schema, str(s), raw, explain, seen) for s, raw in node[kind].items()], explain)
    if kind == "not":
        inner = compile_match(schema, node[kind], explain, seen)
        told = F.when(inner.passed, F.lit("not not None did not match (observed None)"))
        return Node(~inner.passed, inner.tests, told)
    children = [compile_match(schema, child, explain, seen) for child in node[kind]]
    if kind == "all":
        return _all(children, explain)
    if not children:
        return Node(F.lit(True))
    passed = functools.reduce(lambda a, b: a | b, [n.passed for n in children])
    return Node(
        passed,
        [t for n in children for t in n.tests],
        F.when(~passed, _failure(n.failure for n in children)),
    )


# --------------------------------------------------------------------------- policy sets


def ordered(policies: Iterable[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Enabled policies, highest priority first, then by key."""
    live = [dict(p) for p in policies if p.get("enabled", True)]
    return sorted(live, key=lambda p: (-int(p.get("priority", 100)), p["key"]))


def violations(policy: Mapping[str, Any]) -> list[str]:
    """What makes a policy document unusable; empty when nothing does."""
    found = []
    effect = policy.get("effect")
    if effect not in EFFECT_RANK:
        found.append(f"unknown effect {effect!r}")
    if effect == DENY and policy.get("obligations"):
        found.append("a deny policy cannot carry obligations")
    for duty in policy.get("obligations") or []:
        kind = str(duty.get("type", "")).strip().lower()
        needs = O.NEEDS_ONE_OF.get(kind)
        if needs is None:
            found.append(f"unknown obligation type {kind!r}")
            continue
        if not any(n in duty for n in needs):
            found.append(f"{kind} needs one of {', '.join(needs)}")
        if kind == "redact":
            labels = duty.get("labels") or duty.get("classifications") or []
            labels = [labels] if isinstance(labels, str) else labels
            unknown = [x for x in labels if x != "*" and not taxonomy.is_known(str(x))]
            if unknown:
                found.append(f"redact names unknown labels: {', '.join(map(str, unknown))}")
            if str(duty.get("strategy", "mask")).lower() not in O.STRATEGIES:
                found.append(f"unknown redaction strategy {duty['strategy']!r}")
        if kind == "require_purpose" and not (isinstance(duty.get("purposes"), (list, tuple)) and duty["purposes"]):
            found.append("require_purpose needs a non-empty list of purposes")
        if kind == "route":
            if duty.get("require") is not None and not isinstance(duty["require"], Mapping):
                found.append("route.require must be an object")
            if duty.get("to") is not None and not isinstance(duty["to"], str):
                found.append("route.to must be a name")
        if kind == "limit":
            for name in O.LIMITS:
                value = duty.get(name)
                if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                    found.append(f"limit.{name} must be a non-negative integer")
    return found


def usable(policies: Iterable[Mapping[str, Any]]) -> tuple[list[dict[str, Any]], list[str]]:
    """Policies that can run, and one error line for each that cannot."""
    good, errors = [], []
    for policy in policies:
        wrong = violations(policy)
        if wrong:
            errors.append(f"policy {policy['key']!r} (v{policy.get('version', 1)}) is invalid: {'; '.join(wrong)}")
        else:
            good.append(dict(policy))
    return good, errors


def _strongest(matched: Column, effect: str) -> Column:
    """The matching policy of an effect with the highest priority, ties to the largest key."""
    return F.array_max(
        F.transform(
            F.filter(matched, lambda m: m["effect"] == effect),
            lambda m: F.struct(m["priority"], m["key"], m["name"], m["effect"]),
        )
    )


def combine(matched: Column, algorithm: str) -> Column:
    """The determining policy as ``(priority, key, name, effect)``, or null."""
    if algorithm == "priority_ordered":
        rank = F.create_map(*[F.lit(x) for pair in EFFECT_RANK.items() for x in pair])
        best = F.array_max(
            F.transform(
                matched,
                lambda m: F.struct(m["priority"], rank[m["effect"]], m["key"], m["name"], m["effect"]),
            )
        )
        return F.when(
            best.isNotNull(),
            F.struct(best["priority"].alias("priority"), best["key"].alias("key"), best["name"].alias("name"), best["effect"].alias("effect")),
        )
    return F.coalesce(*[_strongest(matched, effect) for effect in PRECEDENCE[algorithm]])


def decided_effect(tested: Sequence[tuple[Mapping[str, Any], Column]], algorithm: str, default_effect: str) -> Column:
    """The effect alone, from ``(policy, whether it matches)``: the first that matches, strongest first.

    It needs no list of the matching policies, so a caller that reads nothing else builds none.
    """
    if algorithm == "priority_ordered":
        turns = sorted(tested, key=lambda t: (int(t[0].get("priority", 100)), EFFECT_RANK.get(t[0]["effect"], -1), t[0]["key"]), reverse=True)
    else:
        turns = [t for effect in PRECEDENCE[algorithm] for t in tested if t[0]["effect"] == effect]
    told = F.lit(default_effect)
    for policy, passed in reversed(turns):
        told = F.when(passed, F.lit(policy["effect"])).otherwise(told)
    return told


def evaluate(
    df: DataFrame,
    policies: Iterable[Mapping[str, Any]],
    algorithm: str = "deny_overrides",
    default_effect: str = DENY,
    load_errors: Sequence[str] = (),
    explain: bool = False,
) -> DataFrame:
    """Decide every row of a request table. A narrow projection: no join, no shuffle.

    Adds effect, determining_policy, matched_policies, obligations, reason,
    policies_evaluated, policy_errors and, on request, trace.
    """
    if algorithm not in ALGORITHMS:
        raise C.PolicyError(f"unknown algorithm {algorithm!r}")
    live = ordered(policies)
    errors = list(load_errors)
    schema = df.schema
    nodes: list[tuple[dict[str, Any], Node]] = []
    seen: Seen = {}
    for policy in live:
        try:
            nodes.append((policy, compile_match(schema, policy.get("match"), explain, seen)))
        except C.PolicyError as wrong:
            errors.append(f"policy {policy['key']!r} failed to evaluate: {wrong}")

    # Columns of their own: the optimizer copies none that is read twice, so each is worked out once per row.
    ready = df.withColumns(dict(seen.values())) if seen else df
    passed = {f"_passed_{i}": node.passed for i, (_, node) in enumerate(nodes)}
    ready = ready.withColumns(passed) if passed else ready
    nodes = [(p, replace(node, passed=F.col(name))) for (p, node), name in zip(nodes, passed, strict=True)]

    entry = f"struct<key:string,name:string,priority:int,effect:string,obligations:{O.OBLIGATIONS}>"
    matched = [
        F.when(
            node.passed,
            F.struct(
                F.lit(p["key"]).alias("key"),
                F.lit(p.get("name", p["key"])).alias("name"),
                F.lit(int(p.get("priority", 100))).alias("priority"),
                F.lit(p["effect"]).alias("effect"),
                O.literal(p.get("obligations") or []).alias("obligations"),
            ),
        )
        for p, node in nodes
    ]
    hits = F.filter(F.array(*matched), lambda m: m.isNotNull()) if matched else F.array()
    out = ready.withColumn("_matched", hits.cast(f"array<{entry}>"))
    out = out.withColumn("_winner", combine(F.col("_matched"), algorithm))
    effect = decided_effect([(p, node.passed) for p, node in nodes], algorithm, default_effect)
    others = F.array_sort(
        F.filter(
            F.transform("_matched", lambda m: m["key"]), lambda k: k != F.col("_winner.key")
        )
    )
    reason = F.when(
        F.col("_winner").isNull(), F.lit(f"no policy matched; applied the default effect '{default_effect}'")
    ).otherwise(
        F.concat(
            F.lit("'"),
            F.col("_winner.name"),
            F.lit("' ("),
            F.col("_winner.key"),
            F.lit(", priority "),
            F.col("_winner.priority").cast("string"),
            F.lit(") produced '"),
            F.col("_winner.effect"),
            F.lit(f"' under {algorithm}"),
            F.when(F.size(others) > 0, F.concat(F.lit("; also matched: "), F.array_join(others, ", "))).otherwise(F.lit("")),
        )
    )
    if errors:
        reason = F.concat(reason, F.lit(f"; {len(errors)} policy/policies failed to evaluate"))
    out = (
        out.withColumn("effect", effect)
        .withColumn("determining_policy", F.col("_winner.key"))
        .withColumn("matched_policies", F.transform("_matched", lambda m: m["key"]))
        .withColumn("obligations", duties(F.col("_matched"), F.col("effect")))
        .withColumn("reason", reason)
        .withColumn("policies_evaluated", F.lit(len(live)))
        .withColumn("policy_errors", F.array(*[F.lit(e) for e in errors]).cast("array<string>"))
    )
    if explain:
        traces = [_trace(p, node) for p, node in nodes]
        out = out.withColumn("trace", F.array(*traces).cast(f"array<{TRACE}>"))
    return out.drop("_matched", "_winner", *passed, *(name for name, _ in seen.values()))


def _outcomes(df: DataFrame, policies: Iterable[Mapping[str, Any]]) -> Column:
    """How every test of the policies turns out for a row."""
    tests: list[Column] = []
    for policy in ordered(policies):
        try:
            tests += compile_match(df.schema, policy.get("match"), explain=True).tests
        except C.PolicyError:  # ``evaluate`` leaves it out, too
            continue
    return F.array(*[t["passed"] for t in tests]).cast("array<boolean>")


def evaluate_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    kept: Sequence[str],
    policies: Sequence[Mapping[str, Any]],
    effect: str = ALLOW,
    algorithm: str = "deny_overrides",
    default_effect: str = DENY,
) -> DataFrame:
    """``kept`` of all pairs of rows with equal ``on`` that ``evaluate`` decides to be ``effect``, without making the others.

    Each side brings roots of its own, such as ``resource`` and ``principal``. All that a policy sees of a row is how
    its tests turn out, so one pair is decided for all whose tests turn out the same: at most two to the power of the
    tests, whatever the tables hold. The rows of ``right`` are cut into blocks, which are spread over the cores and
    met by every row of ``left`` that may, so that no frequent key stands in memory.
    """
    shared = set(left.columns) & set(right.columns) - set(on)
    if shared:
        raise ValueError(f"both sides have {', '.join(sorted(shared))}")
    classes, rows = [], []
    for name, df in (("_left", left), ("_right", right)):
        told = df.dropna(subset=list(on)).withColumn(name, _outcomes(df, policies))
        one = F.any_value(F.struct(*[c for c in df.columns if c in C.ROOTS], F.lit(0).alias(f"{name}_any"))).alias("one")
        classes.append(told.groupBy(name).agg(one).select(name, "one.*"))
        rows.append(told.select(*on, *[c for c in df.columns if c in kept and c not in on], name))
    met = evaluate(classes[0].crossJoin(classes[1]), policies, algorithm, default_effect)
    decided = cut(met.where(F.col("effect") == effect).select("_left", "_right"), "decided")
    some = rows[1].join(decided.select("_right").distinct(), "_right", "left_semi")
    turn = F.row_number().over(Window.partitionBy(*on, "_right").orderBy(*some.columns))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("_block")
    held = some.groupBy(*on, "_right").agg(F.count("*").alias("n")).select(*on, "_right", blocks)
    meeting = rows[0].join(decided, "_left").join(held, [*on, "_right"]).drop("_left")
    tasks, keys = 4 * left.sparkSession.sparkContext.defaultParallelism, [*on, "_right", "_block"]
    numbered = some.withColumn("_block", F.floor((turn - 1) / BLOCK))
    return meeting.repartition(tasks, *keys).join(numbered.repartition(tasks, *keys).hint("merge"), keys).select(*kept)


def _trace(policy: Mapping[str, Any], node: Node) -> Column:
    failure = node.failure if node.failure is not None else F.lit(None).cast("string")
    tests = F.array(*node.tests) if node.tests else F.array()
    return F.struct(
        F.lit(policy["key"]).alias("key"),
        F.lit(policy.get("name", policy["key"])).alias("name"),
        F.lit(policy["effect"]).alias("effect"),
        F.lit(int(policy.get("priority", 100))).alias("priority"),
        node.passed.alias("matched"),
        F.when(node.passed, F.lit("all conditions matched"))
        .otherwise(F.coalesce(failure, F.lit("did not match")))
        .alias("reason"),
        tests.cast(f"array<{CONDITION}>").alias("conditions"),
    )


def duties(matched: Column, effect: Column) -> Column:
    """Obligations of all matched policies sharing the winning effect, duplicates once."""
    sharing = F.filter(matched, lambda m: m["effect"] == effect)
    union = F.array_distinct(F.flatten(F.transform(sharing, lambda m: m["obligations"])))
    return F.when(effect == DENY, F.array().cast(O.OBLIGATIONS)).otherwise(union)


def duties_for(keys: Column, policies: Iterable[Mapping[str, Any]], effects: Sequence[str]) -> Column:
    """Obligations of named policies whose effect is among those given."""
    parts = [
        F.when(F.array_contains(keys, p["key"]), O.literal(p["obligations"])).otherwise(F.array().cast(O.OBLIGATIONS))
        for p in ordered(policies)
        if p["effect"] in effects and p.get("obligations")
    ]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast(O.OBLIGATIONS)


# --------------------------------------------------------------------------- comparing sets


def simulate(
    df: DataFrame,
    candidate: Iterable[Mapping[str, Any]],
    stored: Iterable[Mapping[str, Any]],
    **options: Any,
) -> DataFrame:
    """Both policy sets over one scan of the requests, and whether the outcome differs."""
    now = evaluate(df, stored, **options)
    names = ("effect", "matched_policies", "determining_policy")
    for name in names:
        now = now.withColumnRenamed(name, f"baseline_{name}")
    now = now.drop("obligations", "reason", "policies_evaluated", "policy_errors", "trace")
    both = evaluate(now, candidate, **options)
    same = (F.col("effect") == F.col("baseline_effect")) & (
        F.array_sort("matched_policies") == F.array_sort("baseline_matched_policies")
    )
    return both.withColumn("changed", ~same)


def sync_diff(incoming: DataFrame, stored: DataFrame, prune: bool = False) -> DataFrame:
    """``(key, change)`` between two ``(key, document)`` tables; version is not content."""
    left = incoming.select("key", F.sha2("document", 256).alias("new"))
    right = stored.select("key", F.sha2("document", 256).alias("old"))
    change = (
        F.when(F.col("old").isNull(), "created")
        .when(F.col("new").isNull(), "removed" if prune else "kept")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("updated")
    )
    return left.join(right, "key", "full_outer").select("key", change.alias("change"))


def next_versions(history: DataFrame, writes: DataFrame) -> DataFrame:
    """New version rows for a batch of writes ``(key, document, change_note, changed_by, written_at)``.

    Several writes of one key in a batch get consecutive versions in time order.
    """
    top = history.groupBy("key").agg(F.max("version").alias("top"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("written_at"))
    return (
        writes.withColumn("turn", turn)
        .join(top, "key", "left")
        .select(
            "key",
            (F.coalesce("top", F.lit(0)) + F.col("turn")).alias("version"),
            "document",
            F.coalesce("change_note", F.when(F.col("top").isNull() & (F.col("turn") == 1), "created").otherwise("updated")).alias("change_note"),
            "changed_by",
            "written_at",
        )
    )


def latest(history: DataFrame) -> DataFrame:
    """The newest version of each policy."""
    newest = history.groupBy("key").agg(F.max("version").alias("version"))
    return history.join(newest, ["key", "version"], "left_semi")


def in_force(history: DataFrame) -> DataFrame:
    """Versions with the span of time each one governed."""
    after = Window.partitionBy("key").orderBy("version")
    return history.withColumn("valid_from", F.col("written_at")).withColumn("valid_to", F.lead("written_at").over(after))


def replay(
    requests: DataFrame,
    versions: Iterable[Mapping[str, Any]],
    at: str = "ts",
    **options: Any,
) -> DataFrame:
    """Re-evaluate requests against the policy text in force at their own time.

    ``versions`` are policy documents with ``valid_from`` and ``valid_to``; versions of one
    key never overlap. Each span becomes a condition on the request's time, so no join or
    regrouping of requests is needed.
    """
    listed = list(versions)
    flags = {}
    for i, version in enumerate(listed):
        test = F.col(at) >= F.lit(version["valid_from"])
        if version.get("valid_to") is not None:
            test = test & (F.col(at) < F.lit(version["valid_to"]))
        flags[f"_active_{i}"] = test
    marked = requests.withColumn(
        "env", F.struct(*_env_fields(requests), *[t.alias(n) for n, t in flags.items()])
    )
    timed = [
        {**v, "match": {"all": [{f"env._active_{i}": True}, v.get("match") or {}]}}
        for i, v in enumerate(listed)
    ]
    return evaluate(marked, timed, **options)


def _env_fields(df: DataFrame) -> list[Column]:
    if "env" not in df.columns:
        return []
    return [F.col("env").getField(n).alias(n) for n in df.schema["env"].dataType.fieldNames()]


# --------------------------------------------------------------------------- stored sets


def listing(
    table: DataFrame,
    enabled: bool | None = None,
    effect: str | None = None,
    tag: str | None = None,
    limit: int | None = 200,
    offset: int = 0,
) -> DataFrame:
    """A page of stored policies, highest priority first; all for ``limit=None``. The tag filter acts before paging."""
    out = table
    if enabled is not None:
        out = out.where(F.col("enabled") == enabled)
    if effect:
        out = out.where(F.col("effect") == effect)
    if tag:
        out = out.where(F.array_contains("tags", tag))
    return out if limit is None else out.orderBy(F.desc("priority"), "key").offset(max(0, offset)).limit(limit)


DUTY_TEXT = "array<map<string,string>>"


def shape_violations(table: DataFrame) -> DataFrame:
    """``(key, violation)`` over a table of ``(key, effect, obligations array<variant>)``."""

    def text(d: Column, name: str) -> Column:
        return F.try_variant_get(d, f"$.{name}", "string")

    def kind_of(d: Column, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(d, f"$.{name}", "variant"))

    duty = F.col("d")
    kind = F.lower(F.trim(text(duty, "type")))
    rows = table.select("key", "effect", F.explode_outer("obligations").alias("d")).withColumn("kind", kind)
    checks = [
        F.when((F.col("effect") == DENY) & duty.isNotNull(), F.lit("deny carries obligations")),
        F.when(duty.isNotNull() & ~F.coalesce(F.col("kind").isin(*O.NEEDS_ONE_OF), F.lit(False)), F.lit("unknown type")),
    ]
    for name, needs in O.NEEDS_ONE_OF.items():
        none = functools.reduce(lambda a, b: a & b, [kind_of(duty, n).isNull() for n in needs])
        checks.append(F.when((F.col("kind") == name) & none, F.lit("missing field")))
    strategy = F.lower(F.coalesce(text(duty, "strategy"), F.lit("mask")))
    listed = F.coalesce(
        F.try_variant_get(duty, "$.labels", "array<string>"),
        F.when(kind_of(duty, "labels") == "STRING", F.array(text(duty, "labels"))),
        F.try_variant_get(duty, "$.classifications", "array<string>"),
        F.array().cast("array<string>"),
    )
    known = ["*", *taxonomy.SEVERITY_OF]
    checks += [
        F.when((F.col("kind") == "redact") & ~strategy.isin(*O.STRATEGIES), F.lit("unknown strategy")),
        F.when((F.col("kind") == "redact") & F.exists(listed, lambda x: ~x.isin(*known)), F.lit("unknown labels")),
        F.when(
            (F.col("kind") == "require_purpose")
            & kind_of(duty, "purposes").isNotNull()
            & (F.coalesce(F.size(F.try_variant_get(duty, "$.purposes", "array<variant>")), F.lit(0)) <= 0),
            F.lit("purposes not a filled list"),
        ),
    ]
    for name in O.LIMITS:
        value = F.try_variant_get(duty, f"$.{name}", "bigint")
        whole = kind_of(duty, name).rlike("^(BIGINT|INT|SMALLINT|TINYINT)") & (value >= 0)
        checks.append(
            F.when(
                (F.col("kind") == "limit") & kind_of(duty, name).isNotNull() & ~F.coalesce(whole, F.lit(False)),
                F.lit("limit not a whole number"),
            )
        )
    found = F.array_distinct(F.array_compact(F.array(*checks)))
    return rows.select("key", F.explode(found).alias("violation")).distinct()


def removed_types(table: DataFrame) -> DataFrame:
    """Stored policies using an obligation type this build does not have."""
    kinds = table.select("key", "effect", "enabled", F.explode("obligations").alias("d")).select(
        "key", "effect", "enabled", F.lower(F.trim(F.try_variant_get("d", "$.type", "string"))).alias("type")
    )
    return kinds.where((F.col("type") != "") & ~F.col("type").isin(*O.NEEDS_ONE_OF)).distinct()


def needing_tokens(table: DataFrame) -> DataFrame:
    """Enabled policies that cannot be honoured while no tokenisation key is set."""
    duty = F.explode("obligations").alias("d")
    return (
        table.where("enabled")
        .select("key", duty)
        .where(
            (F.lower(F.trim(F.try_variant_get("d", "$.type", "string"))) == "redact")
            & (F.lower(F.try_variant_get("d", "$.strategy", "string")) == "tokenize")
        )
        .select("key")
        .distinct()
    )


def policy_table(spark: SparkSession, policies: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Policy documents as a stored table: obligations stay free-form."""
    import json

    rows = [
        (
            p["key"],
            p.get("name", p["key"]),
            p["effect"],
            int(p.get("priority", 100)),
            bool(p.get("enabled", True)),
            int(p.get("version", 1)),
            json.dumps({k: v for k, v in p.items() if k != "version"}, sort_keys=True, default=str),
            [json.dumps(o, sort_keys=True) for o in p.get("obligations") or []],
            list(p.get("tags") or []),
        )
        for p in policies
    ]
    raw = spark.createDataFrame(
        rows,
        "key string, name string, effect string, priority int, enabled boolean, version int,"
        " document string, duties array<string>, tags array<string>",
    )
    return raw.withColumn("obligations", F.transform("duties", F.try_parse_json)).drop("duties")
