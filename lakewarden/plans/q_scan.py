"""Queries over the detectors, validators, arbitration and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import taxonomy, validators
from lakewarden.operators import scan
from lakewarden.operators.rules import RULES, Rule, rules_for
from lakewarden.plans import derived, oracle
from lakewarden.plans.registry import add, query

CORPUS_SCAN = "with " + oracle.scan_ctes()


def corpus_findings(spark: SparkSession, sf: str, **options) -> DataFrame:
    return scan.scan(derived.table(spark, sf, "corpus"), "text", ["id"], **options)


# --------------------------------------------------------------------------- detectors


def _detector(rule: Rule):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return corpus_findings(spark, sf, rules=[rule]).select(
            "id",
            "label",
            "detector",
            F.col("start").alias("start_at"),
            F.col("end").alias("end_at"),
            "value",
            "confidence",
        )

    return build


for _rule in RULES:
    add(f"detect_{_rule.name}", _detector(_rule), oracle.detect_sql(_rule.name))


# --------------------------------------------------------------------------- validators

# Candidate values computed from order keys; (validator, expression).
CANDIDATES = {
    "luhn_checksum": ("luhn", "concat('4', lpad(cast((o_orderkey * 7919) % 1000000007 as string), 9, '0'), lpad(cast(o_orderkey % 100 as string), 2 + cast(o_orderkey % 3 as int), '0'))"),
    "card_validity": ("card", "concat(case o_orderkey % 9 when 0 then '4' when 1 then '51' when 2 then '2221' when 3 then '34' when 4 then '6011' when 5 then '35' when 6 then '36' when 7 then '2720' else '9' end, ' ', lpad(cast((o_orderkey * 1299709) % 1000000007 as string), 12, '0'))"),
    "ssn_validity": ("ssn", "concat(case when o_orderkey % 7 = 0 then '666' else lpad(cast(o_orderkey % 1000 as string), 3, '0') end, '-', lpad(cast(o_orderkey % 90 as string), 2, '0'), '-', lpad(cast(o_orderkey % 9000 as string), 4, '0'))"),
    "npi_validity": ("npi", "lpad(cast(1000000000 + (o_orderkey * 104729) % 900000000 as string), 10, '0')"),
    "iban_validity": ("iban", "concat('DE', lpad(cast(o_orderkey % 98 as string), 2, '0'), ' 3704 0044 ', lpad(cast((o_orderkey * 31) % 1000000007 as string), 10, '0'))"),
    "key_entropy_test": ("key", "case o_orderkey % 4 when 0 then md5(cast(o_orderkey as string)) when 1 then repeat(cast(o_orderkey % 10 as string), 20) when 2 then concat('ab', repeat('xy', 9)) else substr(md5(cast(o_orderkey as string)), 1, 15) end"),
    "password_plausibility": ("password", "case o_orderkey % 6 when 0 then 'changeme' when 1 then 'Hunter2' when 2 then concat('\"', 'ab12', '\"') when 3 then '<password>' when 4 then substr(md5(cast(o_orderkey as string)), 1, 9) else 'xxxxxx' end"),
    "reserved_ip_drop": ("ip", "concat(case o_orderkey % 8 when 0 then '0' when 1 then '127' when 2 then '255' when 3 then '192' when 4 then '198' else cast(o_orderkey % 223 as string) end, '.', cast(cast(floor(o_orderkey / 8) as bigint) % 52 as string), '.2.', cast(o_orderkey % 256 as string))"),
}


def _validator(name: str, check: str, value: str) -> None:
    test = validators.luhn if check == "luhn" else validators.BY_NAME[check]

    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = derived.run(spark, sf, f"select o_orderkey, {value} as value from {{orders}}")
        return rows.select("o_orderkey", "value", test(F.col("value")).alias("valid"))

    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    sql = f"(length({digits}) >= 12 and {oracle.luhn(digits)})" if check == "luhn" else oracle.check_sql(check, "value")
    add(name, build, f"select o_orderkey, value, {sql} as valid from (select o_orderkey, {value} as value from {{orders}}) t")


for _name, (_check, _value) in CANDIDATES.items():
    _validator(_name, _check, _value)


@query(
    "shannon_entropy",
    f"select o_orderkey, round({oracle.entropy('value')}, 6) as bits from (select o_orderkey,"
    " concat(o_orderpriority, cast(o_orderkey as string)) as value from {orders}) t",
)
def shannon_entropy(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "orders").withColumn(
        "value", F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    )
    return rows.select("o_orderkey", F.round(validators.entropy(F.col("value")), 6).alias("bits"))


# --------------------------------------------------------------------------- scans

FINDING_SQL = (
    " select id, label, detector, cast(s as int) as start_at, cast(e as int) as end_at, confidence,"
    f" {oracle.preview_sql('value')} as preview from kept"
)


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select(
        "id", "label", "detector", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "confidence", "preview"
    )


@query("scan_text", CORPUS_SCAN + FINDING_SQL)
def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors over documents and templated rows, overlaps arbitrated, values masked."""
    return _shown(corpus_findings(spark, sf))


_PAGES = "(select cast(page_id as varchar) as id, html as text, '' as hint from {pages})"
_TALK = "(select conv_id || '/' || turn as id, text, '' as hint from {conversations})"


@query("scan_pages", "with " + oracle.scan_ctes(_PAGES) + FINDING_SQL)
def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = derived.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "html")
    return _shown(scan.scan(pages, "html", ["id"]))


@query("scan_conversations", "with " + oracle.scan_ctes(_TALK) + FINDING_SQL)
def scan_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = derived.table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    return _shown(scan.scan(turns, "text", ["id"]))


@query("floor_before_arbitration", "with " + oracle.scan_ctes(floor=0.9) + " select id, label, detector, cast(s as int) as start_at from kept")
def floor_before(spark: SparkSession, sf: str) -> DataFrame:
    """A floor ahead of arbitration: dropping a strong overlap frees a weaker one."""
    found = corpus_findings(spark, sf, min_confidence=0.9)
    return found.select("id", "label", "detector", F.col("start").alias("start_at"))


@query("floor_after_arbitration", CORPUS_SCAN + " select id, label, detector, cast(s as int) as start_at from kept where confidence >= 0.9")
def floor_after(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus_findings(spark, sf).where(F.col("confidence") >= 0.9)
    return found.select("id", "label", "detector", F.col("start").alias("start_at"))


@query(
    "overlap_arbitration",
    CORPUS_SCAN + ", lost as (select label, detector, count(*) as candidates from every group by 1, 2),"
    " won as (select label, detector, count(*) as kept from kept group by 1, 2)"
    " select l.label, l.detector, l.candidates, coalesce(w.kept, 0) as kept from lost l left join won w using (label, detector)",
)
def overlap_arbitration(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates against survivors per detector, from one pass over the text."""
    corpus = derived.table(spark, sf, "corpus")
    both = corpus.withColumn("found", scan.candidates("text", RULES)).select(
        F.col("found"), scan.arbitrate(F.col("found")).alias("kept")
    )
    rows = both.select(
        F.explode_outer(
            F.concat(
                F.transform("found", lambda f: F.struct(f["label"].alias("label"), f["detector"].alias("detector"), F.lit(1).alias("c"), F.lit(0).alias("k"))),
                F.transform("kept", lambda f: F.struct(f["label"].alias("label"), f["detector"].alias("detector"), F.lit(0).alias("c"), F.lit(1).alias("k"))),
            )
        ).alias("r")
    ).where(F.col("r").isNotNull())
    return rows.groupBy("r.label", "r.detector").agg(F.sum("r.c").alias("candidates"), F.sum("r.k").alias("kept"))


_CREDENTIALS = [r.name for r in rules_for(["secret", "pci.iban"])]


@query(
    "narrowed_scan",
    "with " + oracle.scan_ctes(names=_CREDENTIALS) + " select id, label, detector, cast(s as int) as start_at from kept",
)
def narrowed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Only the detectors whose label lies under the wanted families."""
    found = corpus_findings(spark, sf, rules=rules_for(["secret", "pci.iban"]))
    return found.select("id", "label", "detector", F.col("start").alias("start_at"))


@query(
    "length_ceiling",
    "with " + oracle.scan_ctes("(select id, left(text, 1500) as text, '' as hint from {corpus})")
    + ", n as (select id, count(*) as finding_count from kept group by 1) select c.id,"
    " least(length(text), 1500) as scanned_chars, length(text) > 1500 as truncated,"
    " coalesce(finding_count, 0) as finding_count from {corpus} c left join n using (id)",
)
def length_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """The scan ceiling as a feature: what was read, and whether something was not."""
    found = scan.with_findings(derived.table(spark, sf, "corpus"), "text", max_chars=1500)
    return found.select("id", "scanned_chars", "truncated", F.size("findings").alias("finding_count"))


_LEAVES = """(select row_id || p as id, text, hint from (
  select row_id, '/ssn' as p, json_extract_string(body, '$.ssn') as text, 'ssn' as hint from {sensitive_json}
  union all select row_id, '/contact/email', json_extract_string(body, '$.contact.email'), 'email' from {sensitive_json}
  union all select row_id, '/contact/a~1b', json_extract_string(body, '$.contact."a/b"'), 'a/b' from {sensitive_json}
  union all select row_id, '/cards/0', json_extract_string(body, '$.cards[0]'), 'cards' from {sensitive_json}
  union all select row_id, '/cards/1', json_extract_string(body, '$.cards[1]'), 'cards' from {sensitive_json}) t)"""
LEAF_SCAN = "with " + oracle.scan_ctes(_LEAVES)


@query(
    "scan_structured",
    LEAF_SCAN + " select cast(regexp_extract(id, '^[0-9]+') as bigint) as row_id, regexp_extract(id, '/.*') as path,"
    " label, detector, cast(s as int) as start_at, confidence from kept",
)
def scan_structured(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text: every string leaf with its key as context, and the pointer to it."""
    found = scan.scan_structured(derived.table(spark, sf, "sensitive_json"), "body", ["row_id"])
    return found.select("row_id", "path", "label", "detector", F.col("start").alias("start_at"), "confidence")


@query(
    "scan_typed_columns",
    LEAF_SCAN + " select cast(regexp_extract(id, '^[0-9]+') as bigint) as row_id, regexp_extract(id, '/.*') as path,"
    " label, confidence from kept",
)
def scan_typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The same leaves read through a schema: structs and arrays walked when the plan is built."""
    shape = "ssn string, contact struct<email:string,`a/b`:string>, cards array<string>, n bigint, ok boolean"
    rows = derived.table(spark, sf, "sensitive_json").withColumn("body", F.from_json("body", shape))
    return scan.scan_structured(rows, "body", ["row_id"]).select("row_id", "path", "label", "confidence")


@query("string_leaves", "select row_id, count(*) as leaves, cast(sum(length(value)) as bigint) as chars, string_agg(path, ' ' order by path) as paths from (select cast(regexp_extract(id, '^[0-9]+') as bigint) as row_id, regexp_extract(id, '/.*') as path, text as value from " + _LEAVES + " x) y group by 1")
def string_leaves(spark: SparkSession, sf: str) -> DataFrame:
    leaves = scan.leaf_table(derived.table(spark, sf, "sensitive_json"), "body", ["row_id"])
    return leaves.groupBy("row_id").agg(
        F.count("*").alias("leaves"),
        F.sum(F.length("value")).alias("chars"),
        F.array_join(F.array_sort(F.collect_list("path")), " ").alias("paths"),
    )


@query(
    "depth_ceiling",
    "select c_custkey, 1 + c_custkey % 27 as levels, 1 + c_custkey % 27 > 24 as truncated from {customer}",
)
def depth_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """Nesting past the depth limit is reported, not silently skipped."""
    levels = 1 + F.col("c_custkey") % 27
    nested = derived.table(spark, sf, "customer").select(
        "c_custkey",
        levels.alias("levels"),
        F.concat(
            F.repeat(F.lit('{"a":'), levels.cast("int")), F.lit('"x"'), F.repeat(F.lit("}"), levels.cast("int"))
        ).alias("body"),
    )
    leaves = scan.leaf_table(nested, "body", ["c_custkey", "levels"])
    return leaves.groupBy("c_custkey", "levels").agg(F.max("too_deep").alias("truncated"))


@query("masked_preview", f"select id, {oracle.preview_sql('v')} as preview from (select c_custkey as id, case c_custkey % 5 when 0 then 'ab' when 1 then ' ' || c_name || ' ' when 2 then c_name || '@x.org' when 3 then '@' || c_mktsegment else 'a@b@' || c_name end as v from {{customer}}) t")
def masked_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.run(
        spark,
        sf,
        "select c_custkey as id, case c_custkey % 5 when 0 then 'ab' when 1 then ' ' || c_name || ' '"
        " when 2 then c_name || '@x.org' when 3 then '@' || c_mktsegment else 'a@b@' || c_name end as v from {customer}",
    )
    return rows.select("id", scan.preview(F.col("v")).alias("preview"))


@query(
    "context_confidence",
    "with " + oracle.scan_ctes("(select row_id || case when row_id % 2 = 0 then 'a' else 'b' end as id, text, case when row_id % 2 = 0 then 'card ssn' else 'phone' end as hint from {sensitive_text})")
    + " select id, label, detector, confidence from every",
)
def context_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate's confidence, with a field name as context beside the text."""
    rows = derived.table(spark, sf, "sensitive_text").select(
        F.concat(F.col("row_id").cast("string"), F.when(F.col("row_id") % 2 == 0, "a").otherwise("b")).alias("id"),
        "text",
        F.when(F.col("row_id") % 2 == 0, "card ssn").otherwise("phone").alias("hint"),
    )
    found = rows.withColumn("findings", scan.candidates("text", RULES, hint="hint"))
    return scan.explode_findings(found, ["id"]).select("id", "label", "detector", "confidence")


# --------------------------------------------------------------------------- roll-ups

SEVERITY_SQL = "case rank when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'low' end"


def _case(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " else 'low' end"


@query(
    "finding_severity",
    "select urn, l as label, " + _case("l", taxonomy.SEVERITY_OF) + " as severity from (select urn, case when"
    " length(urn) % 3 = 0 then split_part(label, '.', 1) when length(urn) % 3 = 1 then label else 'made.up' end as l from {asset_labels}) t",
)
def finding_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Severity of concrete labels, of prefixes (their worst child) and of unknown ones."""
    third = F.length("urn") % 3
    key = F.when(third == 0, F.substring_index("label", ".", 1)).when(third == 1, F.col("label")).otherwise("made.up")
    rows = derived.table(spark, sf, "asset_labels").select("urn", key.alias("label"))
    return rows.withColumn("severity", taxonomy.severity(F.col("label")))


@query("label_counts", CORPUS_SCAN + " select label, count(*) as n from kept group by 1")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scan.label_counts(corpus_findings(spark, sf))


@query("max_severity", CORPUS_SCAN + " select id, case max(rank) when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'low' end as max_severity from kept group by 1")
def max_severity(spark: SparkSession, sf: str) -> DataFrame:
    return scan.max_severity(corpus_findings(spark, sf), ["id"])


_REGULATION_ROWS = ", ".join(
    f"('{key}', '{r}')" for key, regs in taxonomy.REGULATIONS_OF.items() for r in regs
)


@query(
    "regulations",
    f"with reg(key, regulation) as (values {_REGULATION_ROWS}), have as (select distinct urn, case when length(urn) % 2 = 0"
    " then split_part(label, '.', 1) else label end as key from {asset_labels})"
    " select urn, coalesce(string_agg(distinct regulation, ',' order by regulation), '') as regulations"
    " from have left join reg using (key) group by 1",
)
def regulations(spark: SparkSession, sf: str) -> DataFrame:
    """Regulations per asset from concrete labels and label families."""
    key = F.when(F.length("urn") % 2 == 0, F.substring_index("label", ".", 1)).otherwise(F.col("label"))
    sets = derived.table(spark, sf, "asset_labels").groupBy("urn").agg(F.collect_set(key).alias("keys"))
    return sets.select("urn", F.array_join(taxonomy.regulations(F.col("keys")), ",").alias("regulations"))


@query(
    "scan_summary",
    f"with reg(key, regulation) as (values {_REGULATION_ROWS}),\n" + CORPUS_SCAN.removeprefix("with ")
    + ", per as (select id, label, count(*) as n, max(rank) as rank from kept group by 1, 2),"
    " tot as (select id, string_agg(label || '=' || n, ' ' order by label) as counts, max(rank) as rank, sum(n) as n from per group by 1),"
    " rg as (select id, string_agg(distinct regulation, ',' order by regulation) as regulations from per join reg on key = label group by 1)"
    f" select c.id, coalesce(counts, '') as counts, case when rank is not null then {SEVERITY_SQL} end as max_severity,"
    " coalesce(regulations, '') as regulations, cast(coalesce(n, 0) as int) as finding_count, length(text) as scanned_chars"
    " from {corpus} c left join tot using (id) left join rg using (id)",
)
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.summarise(scan.with_findings(derived.table(spark, sf, "corpus"), "text"))
    counts = F.transform("label_counts", lambda c: F.concat(c["label"], F.lit("="), c["n"].cast("string")))
    return found.select(
        "id",
        F.array_join(counts, " ").alias("counts"),
        "max_severity",
        F.array_join("regulations", ",").alias("regulations"),
        "finding_count",
        "scanned_chars",
    )


@query("findings_by_family", CORPUS_SCAN + " select id, label, cast(s as int) as start_at from kept where label = 'secret' or starts_with(label, 'secret.')")
def findings_by_family(spark: SparkSession, sf: str) -> DataFrame:
    return scan.by_family(corpus_findings(spark, sf), "secret").select("id", "label", F.col("start").alias("start_at"))


_EXPANSION_ROWS = ", ".join(f"('{k}', '{c}')" for k in taxonomy.SEVERITY_OF for c in sorted(taxonomy.expand(k)))


@query(
    "label_expansion",
    f"with ex(key, concrete) as (values {_EXPANSION_ROWS}) select concrete as label, count(*) as assertions from"
    " (select split_part(label, '.', 1) as key from {asset_labels}) t join ex using (key) group by 1",
)
def label_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Family names spelled out to concrete labels; the vocabulary side is 39 rows."""
    keys = derived.table(spark, sf, "asset_labels").select(F.substring_index("label", ".", 1).alias("key"))
    return keys.join(F.broadcast(taxonomy.expansion_table(spark)), "key").groupBy("label").agg(
        F.count("*").alias("assertions")
    )


@query("label_ancestors", "select urn, label, case when contains(label, '.') then split_part(label, '.', 1) else '' end as ancestors from {asset_labels}")
def label_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "asset_labels")
    return rows.select("urn", "label", F.array_join(taxonomy.ancestors(F.col("label")), ",").alias("ancestors"))


_DETECTOR_ROWS = ", ".join(f"('{k}')" for k in sorted(taxonomy.KEYS))


@query(
    "detector_coverage",
    f"with vocab(label) as (values {_DETECTOR_ROWS}),\n" + CORPUS_SCAN.removeprefix("with ")
    + ", rules(label, detector) as (values " + ", ".join(f"('{p.label}', '{n}')" for n, p in oracle.PROBES.items()) + "),"
    " d as (select label, string_agg(detector, ',' order by detector) as detectors from rules group by 1),"
    " n as (select label, count(*) as findings from kept group by 1)"
    " select v.label, coalesce(detectors, '') as detectors, detectors is not null as detectable, coalesce(findings, 0) as findings"
    " from vocab v left join d using (label) left join n using (label)",
)
def detector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Which labels a detector can produce, and how often each did."""
    rules = spark.createDataFrame([(r.label, r.name) for r in RULES], "label string, detector string")
    per_label = rules.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("detector")), ",").alias("detectors"))
    counted = scan.label_counts(corpus_findings(spark, sf)).withColumnRenamed("n", "findings")
    return (
        taxonomy.labels_table(spark)
        .select(F.col("key").alias("label"))
        .join(per_label, "label", "left")
        .join(counted, "label", "left")
        .select(
            "label",
            F.coalesce("detectors", F.lit("")).alias("detectors"),
            F.col("detectors").isNotNull().alias("detectable"),
            F.coalesce("findings", F.lit(0)).alias("findings"),
        )
    )


CUSTOMER_NUMBER = Rule(
    "customer_number",
    "confidential.internal",
    0.6,
    r"\d{9}",
    before="Customer#",
    needles=("Customer#",),
    keywords=("furniture",),
)


@query(
    "custom_detector",
    "select c_custkey, substr(c_name, 10, 9) as value, 9 as start_at, cast(case when c_mktsegment = 'FURNITURE' then 0.78 else 0.48 end as double) as confidence from {customer}",
)
def custom_detector(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's own rule beside the built-in machinery."""
    rows = derived.table(spark, sf, "customer").select("c_custkey", F.concat_ws(" / ", "c_name", "c_mktsegment").alias("t"))
    found = scan.scan(rows, "t", ["c_custkey"], rules=[CUSTOMER_NUMBER])
    return found.select("c_custkey", "value", F.col("start").alias("start_at"), "confidence")
