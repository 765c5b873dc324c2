"""The decision job: enrich, classify, evaluate, route, redact, record.

A request table has ``request_id``, ``principal struct<id,type,attributes>``, ``action``,
``resource struct<urn,kind,classifications,attributes>``, ``context map<string,variant>``,
``payload string`` and whatever else should be carried along. Attributes and context are
``map<string,variant>``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import crypto, taxonomy
from lakewarden.operators import catalog, policy, redact, routing, scan
from lakewarden.operators import obligations as O
from lakewarden.operators.rules import RULES, Rule

#: The highest confidence floor a request with a payload may ask for.
CONFIDENCE_CEILING = 0.5
FINDING_FLOOR = 0.5


def evidence_errors(requests: DataFrame, scan_payload: Column, min_confidence: Column) -> Column:
    """Why a request is rejected for suppressing its own evidence, or null."""
    has_payload = F.col("payload").isNotNull()
    return F.when(has_payload & ~scan_payload, F.lit("payload present but scanning is off")).when(
        has_payload & (min_confidence > CONFIDENCE_CEILING), F.lit("confidence floor is above the ceiling")
    )


def request_errors(requests: DataFrame) -> Column:
    """Why a request cannot be judged at all, or null."""
    known = [*taxonomy.SEVERITY_OF]
    odd = F.filter("resource.classifications", lambda label: ~label.isin(*known))
    size = F.length(F.coalesce("action", F.lit("")))
    return (
        F.when(F.coalesce("principal.id", F.lit("")) == "", F.lit("no principal"))
        .when(~size.between(1, 64), F.lit("action must have 1 to 64 characters"))
        .when(F.size(odd) > 0, F.concat(F.lit("unknown classification labels: "), F.array_join(odd, ", ")))
    )


def fail_closed(decided: DataFrame, error: Column) -> DataFrame:
    """Rows with an error become denials that say so; everything they would allow is withdrawn."""
    step = decided.withColumn("_error", error)
    broken = F.col("_error").isNotNull()
    emptied = {
        "determining_policy": F.lit(None).cast("string"),
        "matched_policies": F.array().cast("array<string>"),
        "obligations": F.array().cast(O.OBLIGATIONS),
    }
    step = step.withColumns(
        {name: F.when(broken, none).otherwise(F.col(name)) for name, none in emptied.items()}
    )
    told = F.concat(F.lit("the decision failed and fails closed: "), F.col("_error"))
    return (
        step.withColumn("effect", F.when(broken, policy.DENY).otherwise(F.col("effect")))
        .withColumn("reason", F.when(broken, told).otherwise(F.col("reason")))
        .withColumn(
            "policy_errors",
            F.when(broken, F.array("_error")).otherwise(F.col("policy_errors")),
        )
        .drop("_error")
    )


def _variant_text(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def scrubbed_context(context: Column, limit: int | None = redact.CONTEXT_LIMIT) -> Column:
    """A variant map fit to be stored, each value as JSON text; strings over ``limit`` are cut (None: whole)."""

    def one(k: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        long = F.lit(False) if limit is None else (kind == "STRING") & (F.length(text) > limit)
        cut = text if limit is None else F.concat(F.left(text, F.lit(limit)), F.lit("..."))
        return (
            F.when(F.lower(k).isin(*redact.SECRET_KEYS), F.lit('"[dropped]"'))
            .when(long, crypto.json_string(cut))
            .when(kind == "STRING", crypto.json_string(text))
            .otherwise(_variant_text(v))
        )

    return F.transform_values(context, one)


def payload_digest(payload: Column, key: bytes) -> Column:
    return crypto.content_digest(payload, key)


def fingerprint(df: DataFrame, key: bytes) -> Column:
    """A keyed digest of everything a reviewer of the request agrees to."""
    strings = T.ArrayType(T.StringType())

    def text(name: str) -> Column:
        return crypto.canonical_json(F.col(name), T.StringType())

    context = scrubbed_context(F.col("context"), None)
    pairs = F.transform(
        F.array_sort(F.map_keys(context)),
        lambda k: F.concat(crypto.json_string(k), F.lit(":"), F.try_element_at(context, k)),
    )
    parts = [
        ("action", text("action")),
        ("classifications", crypto.canonical_json(F.array_sort("resource.classifications"), strings)),
        ("context", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))),
        ("findings", crypto.canonical_json(F.array_sort("findings"), strings)),
        ("payload", text("payload_digest")),
        ("principal_id", text("principal.id")),
        ("principal_type", text("principal.type")),
        ("resource_urn", text("resource.urn")),
    ]
    body = [F.concat(F.lit(f'"{name}":'), value) for name, value in parts]
    return crypto.content_digest(F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")), key)


def guard_tokens(df: DataFrame) -> DataFrame:
    """Deny decisions that demand tokens while no tokenisation key is set."""
    asking = F.filter(
        "obligations", lambda o: (o["type"] == "redact") & (o["strategy"] == "tokenize")
    )
    wanted = F.array_join(
        F.array_sort(
            F.array_distinct(
                F.transform(asking, lambda o: F.concat(F.lit("['"), F.array_join(o["labels"], "', '"), F.lit("']")))
            )
        ),
        ", ",
    )
    step = df.withColumn("_need", F.when(F.col("effect") != policy.DENY, wanted).otherwise(F.lit("")))
    stuck = F.col("_need") != ""
    told = F.concat(
        F.col("reason"),
        F.lit("; denied because the decision requires the 'tokenize' strategy for "),
        F.col("_need"),
        F.lit(" and no tokenisation key is configured, so the obligation cannot be satisfied"),
    )
    return (
        step.withColumn("reason", F.when(stuck, told).otherwise(F.col("reason")))
        .withColumn("effect", F.when(stuck, policy.DENY).otherwise(F.col("effect")))
        .withColumn("obligations", F.when(stuck, F.array().cast(O.OBLIGATIONS)).otherwise(F.col("obligations")))
        .withColumn(
            "policy_errors",
            F.when(
                stuck, F.array_append("policy_errors", F.lit("tokenization is required by policy but no key is set"))
            ).otherwise(F.col("policy_errors")),
        )
        .drop("_need")
    )


def apply_routes(df: DataFrame, models: DataFrame, policies: Iterable[Mapping[str, Any]] = ()) -> DataFrame:
    """Resolve route duties over all ``models``; a route nothing satisfies turns the decision into a deny.

    ``policies`` are those that were evaluated, if the caller has them at hand.
    """
    routes = [o for p in policy.ordered(policies) for o in p.get("obligations") or [] if o["type"] == "route"]
    step = routing.with_route(df.withColumn("original", F.col("resource.urn")), models, routes=routes)
    live = (F.col("effect") != policy.DENY) & F.col("route").isNotNull()
    stuck = live & F.col("route.target").isNull()
    resolved = F.transform(
        "obligations",
        lambda o: F.when(o["type"] == "route", o.withField("resolved", F.col("route.target"))).otherwise(o),
    )
    return (
        step.withColumn(
            "obligations",
            F.when(stuck, F.array().cast(O.OBLIGATIONS)).when(live, resolved).otherwise(F.col("obligations")),
        )
        .withColumn(
            "reason",
            F.when(stuck, F.concat(F.col("reason"), F.lit("; denied because "), F.col("route.reason"))).otherwise(F.col("reason")),
        )
        .withColumn(
            "policy_errors",
            F.when(stuck, F.array_append("policy_errors", F.col("route.reason"))).otherwise(F.col("policy_errors")),
        )
        .withColumn("effect", F.when(stuck, policy.DENY).otherwise(F.col("effect")))
        .drop("original")
    )


def unsupported(obligations: Column, ran_redaction: Column) -> Column:
    """Duties this decision did not carry out itself."""
    done = F.when(ran_redaction, F.array(*[F.lit(t) for t in O.DONE_BY_DECISION])).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_except(O.types_of(obligations), done)


def classify(
    requests: DataFrame,
    rules: Iterable[Rule] = RULES,
    min_confidence: float = FINDING_FLOOR,
    max_chars: int | None = None,
) -> DataFrame:
    """Add payload findings (floor applied after arbitration) and the facts about the scan."""
    found = scan.with_findings(requests, "payload", tuple(rules), max_chars=max_chars, output="payload_findings")
    strong = F.filter("payload_findings", lambda f: f["confidence"] >= min_confidence)
    return (
        found.withColumn("payload_findings", strong)
        .withColumn("findings", scan.labels_of(F.col("payload_findings")))
        .withColumn(
            "env",
            F.struct(F.col("truncated").alias("payload_truncated"), F.col("scanned_chars").alias("payload_scanned")),
        )
        .drop("scanned_chars", "truncated")
    )


def decide(
    requests: DataFrame,
    principals: DataFrame,
    assets: DataFrame,
    labels: DataFrame,
    policies: Iterable[Mapping[str, Any]],
    key: bytes,
    token_key: bytes | None = None,
    rules: Iterable[Rule] = RULES,
    min_confidence: float = FINDING_FLOOR,
    max_chars: int | None = None,
    algorithm: str = "deny_overrides",
    default_effect: str = policy.DENY,
    apply_obligations: bool = True,
    explain: bool = False,
) -> DataFrame:
    """Decide every request. Joins touch the catalog only; requests are read once.

    Policies that cannot be used become an error on every decision. A failing task fails
    the job, which then emits nothing: the closed state.
    """
    good, errors = policy.usable(policies)
    step = classify(requests, rules, min_confidence, max_chars)
    step = catalog.enrich_principals(step, principals)
    resolved = catalog.resolve(requests.select(F.col("resource.urn").alias("urn")), assets, labels)
    step = catalog.enrich_resources(step, resolved)
    step = step.withColumn(
        "classifications", F.array_sort(F.array_union("resource.classifications", "findings"))
    )
    step = policy.evaluate(step, good, algorithm, default_effect, errors, explain)
    step = fail_closed(step, request_errors(step))
    step = step.withColumn("payload_digest", payload_digest(F.col("payload"), key))
    step = step.withColumn("fingerprint", fingerprint(step, key))
    return finish(step, good, assets, labels, key, token_key, apply_obligations)


def finish(
    decided: DataFrame,
    policies: Iterable[Mapping[str, Any]],
    assets: DataFrame,
    labels: DataFrame,
    key: bytes,
    token_key: bytes | None = None,
    apply_obligations: bool = True,
) -> DataFrame:
    """Guards, routing and redaction of evaluated requests."""
    step = decided
    duties = [o for p in policies for o in p.get("obligations") or []]
    asked = sorted({O.shaped(o)["strategy"] for o in duties if o["type"] == "redact"})
    if not token_key and "tokenize" in asked:
        step = guard_tokens(step)
    if any(o["type"] == "route" for o in duties):
        step = apply_routes(step, routing.model_table(assets, labels), policies)
    else:
        step = step.withColumn("route", F.lit(None).cast("struct<target:string>"))
    allowed = (F.col("effect") == policy.ALLOW) & F.lit(apply_obligations)
    step = redact.with_redaction(
        step, "payload", "payload_findings", "obligations", key, token_key, allowed, asked
    ).withColumnRenamed("redacted", "payload_out")
    ran = allowed & F.col("payload").isNotNull() & ~F.col("env.payload_truncated")
    return (
        step.withColumn("unsupported_obligations", unsupported(F.col("obligations"), ran))
        .withColumn("residual_labels", F.when(ran, scan.labels_of(F.col("unhandled"))).otherwise(F.array().cast("array<string>")))
        .withColumn("regulations", taxonomy.regulations(F.col("classifications")))
        .withColumn("finding_count", F.size("payload_findings"))
        .withColumn("redaction_count", F.size("edits"))
        .drop("unhandled")
    )


RECORD_COLUMNS = (
    "effect",
    "reason",
    "determining_policy",
    "matched_policies",
    "obligations",
    "unsupported_obligations",
    "classifications",
    "finding_count",
    "redaction_count",
    "payload_digest",
    "fingerprint",
)


def records(decided: DataFrame, ids: Iterable[str], context_chars: int | None = redact.CONTEXT_LIMIT) -> DataFrame:
    """The decision table: no payload, no matched values, scrubbed context."""
    return decided.select(
        *ids,
        F.col("principal.id").alias("principal_id"),
        F.col("principal.type").alias("principal_type"),
        "action",
        F.coalesce("resource.urn", F.lit("")).alias("resource_urn"),
        F.coalesce("resource.kind", F.lit("")).alias("resource_kind"),
        *RECORD_COLUMNS,
        scrubbed_context(F.col("context"), context_chars).alias("context"),
    )


def question_key(df: DataFrame) -> Column:
    """Equal for two requests exactly when the policy engine is asked the same question.

    Values keep their types, so ``true`` and ``"true"`` differ.
    """
    pairs = F.transform(
        F.array_sort(F.map_keys("context")),
        lambda k: F.concat(crypto.json_string(k), F.lit(":"), _variant_text(F.try_element_at("context", k))),
    )
    return F.concat_ws(
        "|",
        F.coalesce("principal.id", F.lit("None")),
        F.coalesce("principal.type", F.lit("None")),
        "action",
        F.coalesce("resource.urn", F.lit("None")),
        crypto.canonical_json(F.array_sort("resource.classifications"), T.ArrayType(T.StringType())),
        F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")),
    )


def distinct_questions(requests: DataFrame) -> DataFrame:
    """One payload-free request per distinct question, with its key; decide these, join back."""
    keyed = requests.where(F.col("payload").isNull()).withColumn("question", question_key(requests))
    columns = [c for c in keyed.columns if c != "question"]
    one = keyed.groupBy("question").agg(F.min_by(F.struct(*columns), "request_id").alias("r"))
    return one.select("question", "r.*")
