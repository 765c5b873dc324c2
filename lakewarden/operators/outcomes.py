"""Decision history: listing, statistics, and reconciling reported outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import obligations as O

# Upper edges of the latency histogram, milliseconds.
LATENCY_EDGES_MS = (1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)
OUTCOMES = ("enforced", "refused", "partial")
TOP_POLICIES = 20


def matching(
    decisions: DataFrame,
    effect: str | None = None,
    principal: str | None = None,
    urn: str | None = None,
    policy: str | None = None,
    outcome: str | None = None,
) -> DataFrame:
    """Decisions under the listing filters; ``unreported`` means permitted and unaccounted for."""
    out = decisions
    for column, value in (
        ("effect", effect),
        ("principal_id", principal),
        ("resource_urn", urn),
        ("determining_policy", policy),
    ):
        if value:
            out = out.where(F.col(column) == value)
    if outcome == "unreported":
        return unreported(out)
    return out.where(F.col("outcome") == outcome) if outcome else out


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in order; the total is ``rows.count()``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit)


def unreported(decisions: DataFrame) -> DataFrame:
    return decisions.where((F.col("effect") == "allow") & F.col("outcome").isNull())


def holding(decisions: DataFrame, labels: Sequence[str] = (), policies: Sequence[str] = ()) -> DataFrame:
    """Decisions whose labels and matched policies contain all those given."""
    out = decisions
    for label in labels:
        out = out.where(F.array_contains("classifications", label))
    for key in policies:
        out = out.where(F.array_contains("matched_policies", key))
    return out


def totals(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("total"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 3).alias("avg_latency_ms"),
        F.coalesce(F.sum("redaction_count"), F.lit(0)).alias("total_redactions"),
        F.count_if((F.col("effect") == "allow") & F.col("outcome").isin("refused", "partial")).alias(
            "permitted_but_not_enforced"
        ),
    )


def by_effect(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("effect").agg(F.count("*").alias("n"))


def by_outcome(decisions: DataFrame) -> DataFrame:
    """Outcomes of permitted actions; these sum to the allow count."""
    allowed = decisions.where(F.col("effect") == "allow")
    return allowed.groupBy(F.coalesce("outcome", F.lit("unreported")).alias("outcome")).agg(F.count("*").alias("n"))


def by_policy(decisions: DataFrame, top: int = TOP_POLICIES) -> DataFrame:
    counted = decisions.where(F.col("determining_policy").isNotNull()).groupBy(
        F.col("determining_policy").alias("policy")
    )
    return counted.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "policy").limit(top)


def latency_histogram(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts per edge, as a metrics scraper expects them."""
    cells = [F.count_if(F.col("latency_ms") <= edge).alias(f"le_{str(edge).replace('.', '_')}") for edge in LATENCY_EDGES_MS]
    return decisions.groupBy(*by).agg(*cells, F.count("*").alias("le_inf"))


# --------------------------------------------------------------------------- outcome reports


def report_error(reports: DataFrame) -> Column:
    """Why an outcome report is refused, or null."""
    silent = F.trim(F.coalesce("reason", F.lit(""))) == ""
    return (
        F.when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), F.lit("unknown outcome"))
        .when((F.col("outcome") != "enforced") & silent, F.lit("needs a reason"))
        .when(
            (F.col("outcome") == "partial") & (F.coalesce(F.size("undischarged"), F.lit(0)) <= 0),
            F.lit("must name what was not discharged"),
        )
    )


def reconcile(reports: DataFrame, order: str = "reported_at") -> DataFrame:
    """Tag each report of a decision: ``recorded`` (the first), ``repeat`` or ``conflict``.

    Only the first report per decision is needed to judge the rest, so it is found by a
    partial aggregate and joined back; no window over a decision's reports.
    """
    first = reports.groupBy("decision_id").agg(
        F.min_by(F.struct("report_id", "outcome"), F.struct(order, "report_id")).alias("_first")
    )
    tag = (
        F.when(F.col("report_id") == F.col("_first.report_id"), "recorded")
        .when(F.col("outcome").eqNullSafe(F.col("_first.outcome")), "repeat")
        .otherwise("conflict")
    )
    return reports.join(first, "decision_id").withColumn("verdict", tag).withColumn(
        "recorded_outcome", F.col("_first.outcome")
    ).drop("_first")


def correct(reports: DataFrame) -> DataFrame:
    """Move duties falsely claimed discharged to where they belong.

    Only duties the decision itself is the executor of can be contradicted, and only when
    its record says it left them undone (``unsupported_obligations``).
    """
    own = F.array(*[F.lit(t) for t in O.DONE_BY_DECISION])
    claimed = F.array_sort(F.array_distinct("discharged"))
    wrong = F.array_intersect(F.array_intersect(claimed, F.col("unsupported_obligations")), own)
    step = reports.withColumn("contradicted", F.coalesce(F.array_sort(wrong), F.array().cast("array<string>")))
    any_wrong = F.size("contradicted") > 0
    told = F.concat(
        F.lit("corrected: "),
        F.array_join("contradicted", ", "),
        F.lit(" was reported discharged, and this decision recorded it as handed over undischarged"),
    )
    return (
        step.withColumn("submitted_outcome", F.col("outcome"))
        .withColumn("outcome", F.when(any_wrong, "partial").otherwise(F.col("outcome")))
        .withColumn(
            "reason",
            F.when(any_wrong, F.concat_ws("; ", F.nullif(F.col("reason"), F.lit("")), told)).otherwise(F.col("reason")),
        )
        .withColumn("discharged", F.array_except(claimed, F.col("contradicted")))
        .withColumn("undischarged", F.array_sort(F.array_union("undischarged", "contradicted")))
    )


def record_outcomes(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Decisions with their first valid report written in, corrected where contradicted."""
    valid = reports.where(report_error(reports).isNull())
    first = reconcile(valid).where(F.col("verdict") == "recorded")
    known = decisions.select("decision_id", "unsupported_obligations")
    fixed = correct(first.join(known, "decision_id")).select(
        "decision_id",
        "outcome",
        F.col("reason").alias("outcome_reason"),
        F.col("reported_at").alias("outcome_reported_at"),
        "discharged",
        "undischarged",
        "contradicted",
    )
    fields = [c for c in decisions.columns if c not in fixed.columns or c == "decision_id"]
    return decisions.select(*fields).join(fixed, "decision_id", "left")


