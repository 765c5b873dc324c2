"""Rewriting found values: six strategies, applied to text and to nested data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import crypto, taxonomy
from lakewarden.operators import scan
from lakewarden.operators.obligations import STRATEGIES
from lakewarden.operators.rules import RULES, Rule
from lakewarden.session import spread

EDIT = "struct<label:string,strategy:string,start:int,end:int,replacement:string>"

# Context keys never stored, and the longest context string stored whole by default.
SECRET_KEYS = ("authorization", "token", "api_key", "apikey", "password", "secret", "cookie")
CONTEXT_LIMIT = 512


# --------------------------------------------------------------------------- strategies


def mask(label: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), label, F.lit("]"))


def partial(value: Column, keep: Column) -> Column:
    """Stars for letters and digits ahead of the kept suffix; punctuation stays."""
    size = F.length(value)
    kept = F.greatest(F.lit(0), F.least(keep, size))
    head = F.regexp_replace(F.left(value, size - kept), r"[\p{L}\p{N}]", "*")
    return F.when(kept == 0, F.repeat(F.lit("*"), size)).otherwise(F.concat(head, F.right(value, kept)))


def hashed(label: Column, value: Column, length: Column, key: bytes = b"") -> Column:
    digest = crypto.hmac_sha256(key or crypto.UNKEYED_REDACTION, F.encode(F.concat(label, F.lit(":"), value), "UTF-8"))
    size = F.greatest(F.lit(4), F.least(length, F.lit(64)))
    return F.concat(F.lit("<"), label, F.lit(":"), F.left(digest, size), F.lit(">"))


def synthetic(label: Column, value: Column, key: bytes = b"") -> Column:
    """A same-shaped stand-in drawn from a keyed digest of the value."""
    message = F.concat(F.lit("synth:"), label, F.lit(":"), value)
    digest = crypto.hmac_sha256(key or crypto.UNKEYED_REDACTION, F.encode(message, "UTF-8"))
    # One decimal digit per digest byte; a one-element array lets the digest be computed once.
    numbers = F.array_join(
        F.transform(
            F.split(F.regexp_replace(digest, "(..)", "$1 "), " "),
            lambda h: F.pmod(F.conv(h, 16, 10).cast("int"), F.lit(10)).cast("string"),
        ),
        "",
    )

    def shape(d: Column) -> Column:
        def same_kind(char: Column, at: Column) -> Column:
            return (
                F.when(char.rlike(r"^\p{N}$"), F.substring(d, F.pmod(at, F.lit(32)) + 1, F.lit(1)))
                .when(char.rlike(r"^\p{L}$"), F.lit("x"))
                .otherwise(char)
            )

        return (
            F.when(label == "pii.email", F.concat(F.lit("user"), F.left(d, F.lit(6)), F.lit("@example.invalid")))
            .when(label == "pii.phone", F.concat(F.lit("+1555"), F.left(d, F.lit(7))))
            .when(
                label == "pii.ssn",
                F.concat(F.lit("900-"), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 4)),
            )
            .when(label == "pci.card_number", F.concat(F.lit("4000"), F.left(d, F.lit(12))))
            .otherwise(F.array_join(F.transform(F.split(value, ""), same_kind), ""))
        )

    return F.transform(F.array(numbers), shape)[0]


def replacement(
    rule: Column,
    label: Column,
    value: Column,
    key: bytes,
    token_key: bytes | None,
    strategies: Sequence[str] = STRATEGIES,
) -> Column:
    """What stands in for a value under an obligation. Tokenising without a key is an error.

    ``strategies`` are those the rules can hold; leaving out others keeps the plan small.
    """

    def minted() -> Column:
        if not token_key:
            return F.raise_error(F.lit("a rule asks for tokens but no tokenisation key is set")).cast("string")
        return crypto.token(label, value, token_key)

    build = {
        "mask": lambda: mask(label),
        "drop": lambda: F.lit(""),
        "partial": lambda: partial(value, rule["keep_last"]),
        "hash": lambda: hashed(label, value, rule["hash_length"], key),
        "tokenize": minted,
        "synthetic": lambda: synthetic(label, value, key),
    }
    out = F.lit(None).cast("string")
    for name in strategies:
        out = F.when(rule["strategy"] == name, build[name]()).otherwise(out)
    return out


# --------------------------------------------------------------------------- choosing rules


def redactions_in(obligations: Column) -> Column:
    return F.filter(obligations, lambda o: o["type"] == "redact")


def rule_for(obligations: Column, label: Column) -> Column:
    """The first redact obligation covering a label, or null."""
    fits = F.filter(
        obligations,
        lambda o: (o["type"] == "redact")
        & F.exists(o["labels"], lambda p: (p == "*") | taxonomy.covers(p, label)),
    )
    return F.get(fits, F.lit(0))


# --------------------------------------------------------------------------- applying them


def with_redaction(
    df: DataFrame,
    text: str,
    findings: str = "findings",
    obligations: str = "obligations",
    key: bytes = b"",
    token_key: bytes | None = None,
    when: Column | None = None,
    strategies: Sequence[str] = STRATEGIES,
) -> DataFrame:
    """Add ``redacted``, the ``edits`` made in text order, and ``unhandled`` findings.

    Offsets in ``edits`` are those of the original text. Where ``when`` is false the row is
    left alone: no text, no edits.
    """
    wanted = F.lit(True) if when is None else when
    body = F.col(text)

    def chosen(f: Column) -> Column:
        return F.struct(f.alias("f"), rule_for(F.col(obligations), f["label"]).alias("rule"))

    def edit(c: Column) -> Column:
        f, rule = c["f"], c["rule"]
        return F.struct(
            f["label"].alias("label"),
            rule["strategy"].alias("strategy"),
            f["start"].alias("start"),
            f["end"].alias("end"),
            replacement(rule, f["label"], f["value"], key, token_key, strategies).alias("replacement"),
        )

    no_edits = F.array().cast(f"array<{EDIT}>")
    step = df.withColumn("_chosen", F.transform(F.col(findings), chosen))
    step = step.withColumn(
        "edits",
        F.when(
            wanted,
            F.transform(F.filter("_chosen", lambda c: c["rule"].isNotNull()), edit).cast(f"array<{EDIT}>"),
        ).otherwise(no_edits),
    ).withColumn(
        "unhandled",
        F.when(
            wanted, F.transform(F.filter("_chosen", lambda c: c["rule"].isNull()), lambda c: c["f"])
        ).otherwise(F.array().cast(scan.NO_FINDINGS)),
    )
    return step.withColumn("redacted", F.when(wanted, rebuilt(body, F.col("edits")))).drop("_chosen")


def rebuilt(text: Column, edits: Column) -> Column:
    """The text with every edit applied; one pass, left to right."""

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(edits, i)["end"])
        return F.concat(F.substring(text, before + 1, e["start"] - before), e["replacement"])

    last = F.try_element_at(edits, F.lit(-1))["end"]
    tail = F.substring(text, last + 1, F.length(text))
    return F.when(F.size(edits) == 0, text).otherwise(
        F.concat(F.array_join(F.transform(edits, piece), ""), tail)
    )


def redact_text(
    df: DataFrame,
    text: str,
    obligations: Column,
    rules: Sequence[Rule] = RULES,
    key: bytes = b"",
    token_key: bytes | None = None,
) -> DataFrame:
    """Scan a text column and rewrite it under fixed obligations."""
    found = scan.with_findings(df, text, rules).withColumn("obligations", obligations)
    return with_redaction(found, text, key=key, token_key=token_key)


def summary(edits: Column, unhandled: Column) -> Column:
    """Counts and label lists of one rewritten row."""

    def counted(strategy: str) -> Column:
        mine = F.filter(edits, lambda e: e["strategy"] == strategy)
        return F.struct(F.lit(strategy).alias("strategy"), F.size(mine).alias("n"))

    by_strategy = F.filter(F.array(*[counted(s) for s in STRATEGIES]), lambda c: c["n"] > 0)
    return F.struct(
        F.size(edits).alias("redaction_count"),
        F.map_from_entries(by_strategy).alias("by_strategy"),
        F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["label"]))).alias("labels_redacted"),
        scan.labels_of(unhandled).alias("unhandled_labels"),
    )


def residual_labels(findings: Column, obligations: Column) -> Column:
    """Labels found that no redact obligation covers."""
    return F.array_sort(
        F.filter(
            F.array_distinct(F.transform(findings, lambda f: f["label"])),
            lambda label: rule_for(obligations, label).isNull(),
        )
    )


def edit_records(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per edit, in document order within a row."""
    rows = df.select(*ids, F.posexplode_outer("edits").alias("position", "_e"))
    return rows.where(F.col("_e").isNotNull()).select(*ids, "position", "_e.*")


# --------------------------------------------------------------------------- nested data


def _rewrite_variant(node: Column, path: Column, edited: Column, depth: int) -> Column:
    """JSON text of a VARIANT with leaves replaced by those of ``edited``, which are JSON already.

    What lies below the depth limit was not scanned and becomes null.
    """
    kind = scan.variant_kind(node)
    as_is = F.to_json(node)
    if depth > scan.MAX_DEPTH:
        return F.lit("null")

    def member(c: Column) -> Column:
        below = F.concat(path, F.lit("/"), scan.pointer_token(c["key"]))
        name = F.when(c["named"], F.concat(F.to_json(c["key"].cast("variant")), F.lit(":"))).otherwise(F.lit(""))
        return F.concat(name, _rewrite_variant(c["child"], below, edited, depth + 1))

    # The deeper levels appear once in the expression, or its size would double per level.
    is_object = kind == "OBJECT"
    inner = F.array_join(F.transform(scan.variant_children(node), member), ",")
    container = F.concat(
        F.when(is_object, F.lit("{")).otherwise(F.lit("[")),
        inner,
        F.when(is_object, F.lit("}")).otherwise(F.lit("]")),
    )
    return F.when(kind.isin("OBJECT", "ARRAY"), container).otherwise(
        F.coalesce(F.try_element_at(edited, path), as_is)
    )


def _rewrite_typed(value: Column, dtype: T.DataType, path: Column, edited: Column) -> Column:
    """A typed nested column with edited string leaves replaced."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.try_element_at(edited, path), value)
    if isinstance(dtype, T.StructType):
        parts = [
            _rewrite_typed(
                value.getField(f.name),
                f.dataType,
                F.concat(path, F.lit("/"), scan.pointer_token(F.lit(f.name))),
                edited,
            ).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(
            value,
            lambda v, i: _rewrite_typed(
                v, dtype.elementType, F.concat(path, F.lit("/"), i.cast("string")), edited
            ),
        )
    if isinstance(dtype, T.MapType):
        return F.transform_values(
            value,
            lambda k, v: _rewrite_typed(
                v, dtype.valueType, F.concat(path, F.lit("/"), scan.pointer_token(k)), edited
            ),
        )
    return value


def redact_structured(
    df: DataFrame,
    column: str,
    ids: Sequence[str],
    obligations: Column,
    rules: Sequence[Rule] = RULES,
    key: bytes = b"",
    token_key: bytes | None = None,
) -> DataFrame:
    """Rewrite the string leaves of a nested column in place, and add ``truncated``.

    Leaves are scanned as rows of their own; only rewritten leaves travel back to their row, which
    ``ids`` must name uniquely. A row nested deeper than the limit comes back ``truncated``, with
    null in the place of everything below it: what was not scanned is not delivered.
    """
    df = spread(df)
    leaves = scan.leaf_table(df, column, ids)
    found = scan.with_findings(leaves, "value", rules, hint="hint").drop("truncated").withColumn("obligations", obligations)
    edited = F.when(F.col("redacted").isNotNull(), F.struct("path", "redacted"))
    leaf = F.struct("path", "too_deep", F.when(F.size("edits") > 0, F.col("redacted")).alias("redacted"))
    changed = (
        with_redaction(found, "value", key=key, token_key=token_key)
        # A filter on what was rewritten would be pushed down with copies of the whole scan in it, below the spreading.
        .select(*ids, F.explode_outer(F.filter(F.array(leaf), lambda x: x["redacted"].isNotNull() | x["too_deep"])).alias("_leaf"))
        .where(F.col("_leaf").isNotNull())
        .select(*ids, "_leaf.*")
        .groupBy(*ids)
        .agg(F.map_from_entries(F.collect_list(edited)).alias("_edited"), F.max("too_deep").alias("truncated"))
    )
    dtype = df.schema[column].dataType
    joined = df.join(changed, list(ids), "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    untouched = F.col("_edited").isNull()
    if isinstance(dtype, (T.StringType, T.VariantType)):
        from_text = isinstance(dtype, T.StringType)
        ready = joined.withColumn(
            "_json", F.transform_values("_edited", lambda k, v: F.to_json(v.cast("variant")))
        ).withColumn("_tree", F.try_parse_json(column) if from_text else F.col(column))
        text = _rewrite_variant(F.col("_tree"), F.lit(""), F.col("_json"), 0)
        fresh = F.coalesce(text, F.col(column)) if from_text else F.try_parse_json(text)
        joined = ready.withColumn(column, F.when(untouched, F.col(column)).otherwise(fresh)).drop("_json", "_tree")
    else:
        fresh = _rewrite_typed(F.col(column), dtype, F.lit(""), F.col("_edited"))
        joined = joined.withColumn(column, F.when(untouched, F.col(column)).otherwise(fresh))
    return joined.drop("_edited")


def scrub_context(context: Column, limit: int | None = CONTEXT_LIMIT) -> Column:
    """A string map fit to be stored: credential keys dropped, strings over ``limit`` cut (None: whole)."""

    def one(k: Column, v: Column) -> Column:
        kept = F.when(F.lower(k).isin(*SECRET_KEYS), F.lit("[dropped]"))
        if limit is not None:
            kept = kept.when(F.length(v) > limit, F.concat(F.left(v, F.lit(limit)), F.lit("...")))
        return kept.otherwise(v)

    return F.transform_values(context, one)
