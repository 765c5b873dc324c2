"""Finding sensitive values in text and nested data.

``scan_text`` is one Column: text in, ordered non-overlapping findings out. It needs no
shuffle and no Python, so the scan of a table is a single narrow stage over its splits.
Offsets come from marking: every match is wrapped in two control characters, the text is
cut at them, and a fold over the pieces adds up lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import taxonomy, validators
from lakewarden.operators.rules import CONTEXT_CHARS, NUMERIC_GUARD, RULES, Rule
from lakewarden.session import spread

OPEN, EDGE, PLAIN = "\u0001", "\u0002", "\u0003"
MAX_DEPTH = 24

FINDING = (
    "struct<start:int,end:int,label:string,detector:string,value:string,"
    "confidence:double,severity_rank:int>"
)
NO_FINDINGS = f"array<{FINDING}>"
#: What a findings table has of each finding.
FOUND = ("label", "detector", "start", "end", "value", "confidence", "severity_rank")


def _empty(ddl: str) -> Column:
    return F.array().cast(ddl)


# --------------------------------------------------------------------------- candidates

SPAN = "struct<m0:int,m1:int,start:int,end:int>"


def _quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(where: str, words: Sequence[str]) -> str:
    found = "(" + " or ".join(f"contains({where}, {_quoted(w)})" for w in words) + ")"
    # A sign that all of several words hold is looked for first: most texts have none, and one pass tells.
    signs = [c for c in words[0] if not c.isalnum() and c != " " and all(c in w for w in words)]
    return f"(contains({where}, {_quoted(signs[0])}) and {found})" if signs and len(words) > 1 else found


def _numeric(text: str) -> str:
    return f"{text} rlike {_quoted(NUMERIC_GUARD)}"


def _possible(text: str, lowered: str, numeric: str, hint: str | None, rule: Rule) -> str:
    """Cheap conditions without which the rule cannot find anything, cheapest first."""
    checks = [numeric] if rule.numeric else []
    if rule.needles:
        checks.append(_any_of(lowered if rule.fold_case else text, rule.needles))
    if rule.needs_keyword:
        supported = _any_of(lowered, rule.keywords)
        if hint is not None:
            supported = f"({supported} or {_any_of(f'lower({hint})', rule.keywords)})"
        checks.append(supported)
    if rule.guard:
        # The same flags as the rule: digits of any script must pass the guard as well.
        checks.append(f"{text} rlike {_quoted(f'(?{rule.flags}){rule.guard}')}")
    return " and ".join(checks) or "true"


def _marked(text: str, rule: Rule) -> str:
    """The rule's constants beside the text cut at every match of the rule."""
    marks = f"{OPEN}$1{EDGE}$2{EDGE}$3{EDGE}"
    words = ", ".join(_quoted(w) for w in rule.keywords)
    rank = taxonomy.SEVERITY_RANK[taxonomy.SEVERITY_OF.get(rule.label, "low")]
    return f"""named_struct(
        'label', {_quoted(rule.label)}, 'detector', {_quoted(rule.name)},
        'check', {_quoted(rule.check)}, 'needs_keyword', {str(rule.needs_keyword).lower()},
        'keywords', cast(array({words}) as array<string>),
        'with_keyword', {rule.confidence_with}D, 'without_keyword', {rule.confidence_without}D,
        'severity_rank', {rank},
        'pieces', split(regexp_replace({text}, {_quoted(rule.regex)}, {_quoted(marks)}), {_quoted(OPEN)}))"""


def _hits(text: str, lowered: str, numeric: str, hint: str | None, rules: Sequence[Rule]) -> Column:
    """The rules that match somewhere. Spelled in SQL: one parse instead of a thousand calls."""
    marked = [
        f"case when {_possible(text, lowered, numeric, hint, r)} then {_marked(text, r)} end"
        for r in rules
    ]
    return F.expr(f"filter(array({', '.join(marked)}), m -> m is not null and size(m.pieces) > 1)")


def _spans(pieces: Column) -> Column:
    """Offsets of every match: whole match (``m0``, ``m1``) and value (``start``, ``end``).

    A piece is [before, value, after, gap], except the first, which is only a gap.
    """

    def step(state: Column, piece: Column) -> Column:
        at = state["at"]
        first = F.length(piece[0])
        value = F.length(F.get(piece, F.lit(1)))
        after = F.length(F.get(piece, F.lit(2)))
        gap = F.length(F.get(piece, F.lit(3)))
        span = F.struct(
            at.alias("m0"),
            (at + first + value + after).alias("m1"),
            (at + first).alias("start"),
            (at + first + value).alias("end"),
        )
        return F.when(
            F.size(piece) == 1, F.struct((at + first).alias("at"), state["out"].alias("out"))
        ).otherwise(
            F.struct(
                (at + first + value + after + gap).alias("at"),
                F.array_append(state["out"], span).alias("out"),
            )
        )

    start = F.struct(F.lit(0).alias("at"), _empty(f"array<{SPAN}>").alias("out"))
    cut = F.transform(pieces, lambda piece: F.split(piece, EDGE))
    return F.aggregate(cut, start, step, lambda state: state["out"])


def candidates(
    column: str,
    rules: Sequence[Rule],
    hint: str | None = None,
    lowered: str | None = None,
    numeric: str | None = None,
) -> Column:
    """Every rule's valid, context-scored matches in a text column, before arbitration.

    Only the search itself differs per rule; offsets, validators and scoring are one shared
    expression over the rules that hit.
    """
    if not rules:
        return _empty(NO_FINDINGS)
    hits = _hits(column, lowered or f"lower({column})", numeric or _numeric(column), hint, rules)
    text = F.expr(column)
    checks = sorted({r.check for r in rules if r.check})

    def locate(span: Column) -> Column:
        left = F.greatest(span["m0"] - CONTEXT_CHARS, F.lit(0))
        near = F.substring(text, left + 1, span["m1"] + CONTEXT_CHARS - left)
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.substring(text, span["start"] + 1, span["end"] - span["start"]).alias("value"),
            F.lower(near if hint is None else F.concat(near, F.lit(" "), F.expr(hint))).alias("near"),
        )

    def valid(rule: Column, value: Column) -> Column:
        verdict = F.lit(True)
        for name in checks:
            verdict = F.when(rule["check"] == name, validators.BY_NAME[name](value)).otherwise(verdict)
        return verdict

    def of_rule(rule: Column) -> Column:
        found = F.transform(_spans(rule["pieces"]), locate)
        if checks:
            found = F.filter(found, lambda c: valid(rule, c["value"]))

        def score(c: Column) -> Column:
            supported = F.exists(rule["keywords"], lambda word: F.contains(c["near"], word))
            return F.struct(
                c["start"].alias("start"),
                c["end"].alias("end"),
                rule["label"].alias("label"),
                rule["detector"].alias("detector"),
                c["value"].alias("value"),
                F.when(supported, rule["with_keyword"])
                .when(~rule["needs_keyword"], rule["without_keyword"])
                .alias("confidence"),
                rule["severity_rank"].alias("severity_rank"),
            )

        return F.filter(F.transform(found, score), lambda f: f["confidence"].isNotNull())

    return F.flatten(F.transform(hits, of_rule)).cast(NO_FINDINGS)


# --------------------------------------------------------------------------- arbitration


def arbitrate(findings: Column) -> Column:
    """Of overlapping candidates keep the best by severity, length, confidence, name.

    Candidates are walked in text order and cut into islands that touch nothing else, so
    the pairwise contest runs only inside an island.
    """

    def ranked(island: Column) -> Column:
        keyed = F.transform(
            island,
            lambda f: F.struct(
                f["severity_rank"].alias("severity"),
                (f["end"] - f["start"]).alias("length"),
                f["confidence"].alias("confidence"),
                f["detector"].alias("detector"),
                f.alias("f"),
            ),
        )
        return F.transform(F.sort_array(keyed, asc=False), lambda k: k["f"])

    def contest(island: Column) -> Column:
        kept = F.aggregate(
            ranked(island),
            _empty(NO_FINDINGS),
            lambda won, f: F.when(
                F.exists(won, lambda w: (f["start"] < w["end"]) & (w["start"] < f["end"])), won
            ).otherwise(F.array_append(won, f)),
        )
        return F.when(F.size(island) <= 1, island).otherwise(F.sort_array(kept))

    def step(state: Column, f: Column) -> Column:
        joins = f["start"] < state["reach"]
        return F.when(
            joins,
            F.struct(
                state["done"].alias("done"),
                F.array_append(state["island"], f).alias("island"),
                F.greatest(state["reach"], f["end"]).alias("reach"),
            ),
        ).otherwise(
            F.struct(
                F.concat(state["done"], contest(state["island"])).alias("done"),
                F.array(f).alias("island"),
                f["end"].alias("reach"),
            )
        )

    start = F.struct(
        _empty(NO_FINDINGS).alias("done"),
        _empty(NO_FINDINGS).alias("island"),
        F.lit(0).alias("reach"),
    )
    return F.aggregate(
        F.sort_array(findings),
        start,
        step,
        lambda state: F.concat(state["done"], contest(state["island"])),
    )


# --------------------------------------------------------------------------- text scan


def scan_text(
    column: str,
    rules: Sequence[Rule] = RULES,
    hint: str | None = None,
    lowered: str | None = None,
    numeric: str | None = None,
    min_confidence: float = 0.0,
) -> Column:
    """Findings of one text column, in text order. Null text has none.

    ``min_confidence`` drops candidates before arbitration, so a dropped strong overlap
    frees a weaker one.
    """
    found = candidates(column, rules, hint, lowered, numeric)
    if min_confidence > 0:
        found = F.filter(found, lambda f: f["confidence"] >= min_confidence)
    # Null texts are told apart before any rule is asked.
    return F.coalesce(F.when(F.expr(column).isNotNull(), arbitrate(found)), _empty(NO_FINDINGS))


def unmarked(text: Column) -> Column:
    """The text with the two marker characters neutralised; same length."""
    dirty = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(EDGE))
    return F.when(dirty, F.translate(text, OPEN + EDGE, PLAIN + PLAIN)).otherwise(text)


def with_findings(
    df: DataFrame,
    text: str,
    rules: Sequence[Rule] = RULES,
    hint: str | None = None,
    max_chars: int | None = None,
    min_confidence: float = 0.0,
    output: str = "findings",
) -> DataFrame:
    """Add findings, scanned characters and the truncation flag to each row.

    The whole text is read unless the caller sets a ceiling; past one, ``truncated`` says so.
    """
    body = F.col(text) if max_chars is None else F.left(F.col(text), F.lit(max_chars))
    # Each helper column is read by many rules, which keeps the optimizer from inlining it.
    ready = (
        spread(df)
        .withColumn("_body", unmarked(body))
        .withColumn("_low", F.lower("_body"))
        .withColumn("_num", F.expr(_numeric("_body")))
    )
    found = scan_text("_body", rules, hint, "_low", "_num", min_confidence)
    over = F.lit(False) if max_chars is None else F.coalesce(F.length(F.col(text)) > max_chars, F.lit(False))
    return (
        ready.withColumn(output, found)
        .withColumn("scanned_chars", F.coalesce(F.length("_body"), F.lit(0)))
        .withColumn("truncated", over)
        .drop("_body", "_low", "_num")
    )


def preview(value: Column) -> Column:
    """A masked hint that can be stored."""
    bare = F.trim(value)
    size = F.length(bare)
    local = F.substring_index(bare, "@", 1)
    domain = F.substring_index(bare, "@", -1)
    one_at = size - F.length(F.replace(bare, F.lit("@"), F.lit(""))) == 1
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(local) - 1))
    return (
        F.when(size <= 4, F.repeat(F.lit("*"), size))
        .when(one_at, F.concat(F.left(local, F.lit(1)), stars, F.lit("@"), domain))
        .otherwise(F.concat(F.left(bare, F.lit(1)), F.repeat(F.lit("*"), size - 2), F.right(bare, F.lit(1))))
    )


def explode_findings(df: DataFrame, ids: Sequence[str], findings: str = "findings") -> DataFrame:
    """One row per finding. The outer form keeps the planner from copying the scan into a filter."""
    rows = df.select(*ids, F.explode_outer(findings).alias("_f")).where(F.col("_f").isNotNull())
    return rows.select(*ids, *(F.col(f"_f.{n}").alias(n) for n in FOUND))


def scan(
    df: DataFrame,
    text: str,
    ids: Sequence[str],
    rules: Sequence[Rule] = RULES,
    hint: str | None = None,
    max_chars: int | None = None,
    min_confidence: float = 0.0,
) -> DataFrame:
    """The text scan as a job: a findings table with masked previews, no shuffle."""
    keep = [*ids, text, *([hint] if hint else [])]
    found = with_findings(df.select(*dict.fromkeys(keep)), text, rules, hint, max_chars, min_confidence)
    return explode_findings(found, ids).withColumn("preview", preview(F.col("value")))


# --------------------------------------------------------------------------- nested data


def pointer_token(key: Column) -> Column:
    """RFC 6901 escaping."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


LEAF = "struct<path:string,hint:string,value:string,too_deep:boolean>"


def _leaf(path: Column, hint: Column, value: Column, too_deep: bool = False) -> Column:
    return F.struct(
        path.alias("path"), hint.alias("hint"), value.alias("value"), F.lit(too_deep).alias("too_deep")
    )


def typed_leaves(value: Column, dtype: T.DataType, path: Column, hint: Column) -> Column:
    """String leaves of a typed column, found by walking its schema when the plan is built."""
    none = _empty(f"array<{LEAF}>")
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), F.array(_leaf(path, hint, value))).otherwise(none)
    if isinstance(dtype, T.StructType):
        kids = [
            typed_leaves(
                value.getField(f.name),
                f.dataType,
                F.concat(path, F.lit("/"), pointer_token(F.lit(f.name))),
                F.lit(f.name),
            )
            for f in dtype.fields
            if _holds_text(f.dataType)
        ]
        return F.concat(*kids) if kids else none
    if isinstance(dtype, T.ArrayType) and _holds_text(dtype.elementType):
        nested = F.transform(
            value,
            lambda v, i: typed_leaves(
                v, dtype.elementType, F.concat(path, F.lit("/"), i.cast("string")), hint
            ),
        )
        return F.coalesce(F.flatten(nested), none)
    if isinstance(dtype, T.MapType) and _holds_text(dtype.valueType):
        nested = F.transform(
            F.map_entries(value),
            lambda e: typed_leaves(
                e["value"],
                dtype.valueType,
                F.concat(path, F.lit("/"), pointer_token(e["key"])),
                e["key"],
            ),
        )
        return F.coalesce(F.flatten(nested), none)
    return none


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_holds_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_text(dtype.valueType)
    return False


def variant_kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING`` or another type name."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def variant_children(value: Column) -> Column:
    """Members of a container as ``(key, named, child)``; index keys for arrays."""
    kind = variant_kind(value)
    members = F.transform(
        F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
        lambda e: F.struct(e["key"].alias("key"), F.lit(True).alias("named"), e["value"].alias("child")),
    )
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v, i: F.struct(i.cast("string").alias("key"), F.lit(False).alias("named"), v.alias("child")),
    )
    return F.when(kind == "OBJECT", members).when(kind == "ARRAY", items)


def variant_leaves(value: Column, max_depth: int = MAX_DEPTH) -> Column:
    """String leaves of a VARIANT. A node below ``max_depth`` comes back as ``too_deep``."""
    none = _empty(f"array<{LEAF}>")

    def walk(node: Column, path: Column, hint: Column, depth: int) -> Column:
        if depth > max_depth:
            return F.array(_leaf(path, hint, F.lit(None).cast("string"), True))
        deeper = F.transform(
            variant_children(node),
            lambda c: walk(
                c["child"],
                F.concat(path, F.lit("/"), pointer_token(c["key"])),
                F.when(c["named"], c["key"]).otherwise(hint),
                depth + 1,
            ),
        )
        kind = variant_kind(node)
        return (
            F.when(kind == "STRING", F.array(_leaf(path, hint, F.try_variant_get(node, "$", "string"))))
            .when(kind.isin("OBJECT", "ARRAY"), F.flatten(deeper))
            .otherwise(none)
        )

    return walk(value, F.lit(""), F.lit(""), 0)


def scan_leaves(leaves: DataFrame, ids: Sequence[str], rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """Findings of a ``(ids, path, hint, value)`` leaf table, offsets relative to the leaf.

    ``truncated`` is false for findings. A subtree below the depth limit, whose text nobody looked
    at, comes back as a row of its own: its path, no label, ``truncated`` true.
    """
    found = with_findings(leaves.withColumnRenamed("value", "_leaf_text"), "_leaf_text", rules, "hint", **options)
    unseen = F.array(F.lit(None).cast(FINDING))
    marked = found.withColumn("findings", F.when(F.col("too_deep"), unseen).otherwise(F.col("findings")))
    rows = marked.select(*ids, "path", F.col("too_deep").alias("truncated"), F.explode_outer("findings").alias("_f"))
    rows = rows.where(F.col("truncated") | F.col("_f").isNotNull())
    return rows.select(*ids, "path", *(F.col(f"_f.{n}").alias(n) for n in FOUND), "truncated").withColumn("preview", preview(F.col("value")))


def leaf_table(df: DataFrame, column: str, ids: Sequence[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per string leaf of a column: VARIANT, JSON text, or any typed nesting."""
    # Walking a tree costs far more than reading it, so it must not be left to the few tasks of a small file.
    df = spread(df)
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.VariantType):
        leaves = variant_leaves(F.col(column), max_depth)
    elif isinstance(dtype, T.StringType):
        leaves = variant_leaves(F.try_parse_json(F.col(column)), max_depth)
    else:
        leaves = typed_leaves(F.col(column), dtype, F.lit(""), F.lit(""))
    return (
        df.select(*ids, F.explode_outer(leaves).alias("_leaf"))
        .where(F.col("_leaf").isNotNull())
        .select(*ids, "_leaf.path", "_leaf.hint", "_leaf.value", "_leaf.too_deep")
    )


def scan_structured(
    df: DataFrame,
    column: str,
    ids: Sequence[str],
    rules: Sequence[Rule] = RULES,
    max_depth: int = MAX_DEPTH,
    **options,
) -> DataFrame:
    """Scan every string leaf of a nested column, its key serving as context.

    JSON is walked ``max_depth`` levels deep; what lies deeper is reported, see ``scan_leaves``.
    """
    return scan_leaves(leaf_table(df, column, ids, max_depth), ids, rules, **options)


# --------------------------------------------------------------------------- roll-ups


def labels_of(findings: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["label"])))


def max_severity(findings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Worst severity per id; ids without findings are absent."""
    return findings.groupBy(*ids).agg(
        taxonomy.severity_name(F.max("severity_rank")).alias("max_severity")
    )


def label_counts(findings: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    return findings.groupBy(*ids, "label").agg(F.count("*").alias("n"))


def by_family(findings: DataFrame, pattern: str) -> DataFrame:
    """Findings whose label is, or lies beneath, a pattern."""
    return findings.where(taxonomy.covers(pattern, F.col("label")))


def summarise(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Per-row scan summary: no shuffle, since a row holds all its findings."""
    labels = labels_of(F.col(findings))
    counts = F.transform(
        labels,
        lambda l: F.struct(
            l.alias("label"), F.size(F.filter(F.col(findings), lambda f: f["label"] == l)).alias("n")
        ),
    )
    worst = F.array_max(F.transform(F.col(findings), lambda f: f["severity_rank"]))
    return (
        df.withColumn("labels", labels)
        .withColumn("label_counts", counts)
        .withColumn("max_severity", taxonomy.severity_name(worst))
        .withColumn("regulations", taxonomy.regulations(F.col("labels")))
        .withColumn("finding_count", F.size(findings))
    )
