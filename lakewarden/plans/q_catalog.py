"""Queries over the catalog: resolving, merging, keeping and discovering assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import taxonomy
from lakewarden.operators import catalog, discovery, routing, scan
from lakewarden.plans import derived, oracle
from lakewarden.plans.registry import query
from lakewarden.plans.requests import (
    access_requests,
    asset_labels,
    catalog_assets,
    catalog_principals,
)
from lakewarden.session import cut
from lakewarden.sources import tables as T

_GLOB = "'^' || replace(replace(replace(a.urn, '.', '[.]'), '*', '.*'), '?', '.') || '$'"
#: Distinct requested names with every asset covering each, and labels merged per asset.
COVER = f"""
urns as (select distinct urn from {{requests}}),
cover as (
  select u.urn, a.urn as asset_urn, true as is_exact from urns u join {{assets}} a on a.urn = u.urn
  union all
  select u.urn, a.urn, false from urns u join {{assets}} a on (contains(a.urn, '*') or contains(a.urn, '?')) and a.urn <> u.urn
    and regexp_matches(u.urn, {_GLOB})),
ranked as (select *, row_number() over (partition by urn, label order by case source when 'manual' then 40 when 'imported' then 30 when 'scan' then 20 else 10 end desc, confidence desc) as rn from {{asset_labels}}),
merged as (select urn, label, confidence from ranked where rn = 1),
known as (select c.urn, m.label, max(m.confidence) as confidence from cover c join merged m on m.urn = c.asset_urn group by 1, 2)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    names = derived.table(spark, sf, "requests").select("urn")
    return catalog.resolve(names, catalog_assets(spark, sf), asset_labels(spark, sf))


@query(
    "resolve_urn",
    "with " + COVER.strip() + ", p as (select urn, string_agg(asset_urn, ' ' order by length(asset_urn), asset_urn) as patterns from cover where not is_exact group by 1),"
    " l as (select urn, string_agg(label, ' ' order by label) as labels from known group by 1)"
    " select u.urn, (p.urn is not null or e.urn is not null) as registered, coalesce(patterns, '') as patterns, coalesce(labels, '') as labels"
    " from urns u left join p using (urn) left join l using (urn) left join (select urn from cover where is_exact) e using (urn)",
)
def resolve_urn(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and pattern assets covering each requested name, and the labels they bring."""
    return _resolved(spark, sf).select(
        "urn",
        "registered",
        F.array_join("matched_patterns", " ").alias("patterns"),
        F.array_join(F.array_sort(F.map_keys("label_confidence")), " ").alias("labels"),
    )


@query(
    "cover_by_literals",
    "select distinct r.urn, g.urn as pattern from {requests} r join {globs} g on r.urn glob g.urn and r.urn <> g.urn",
)
def cover_by_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Requested names under patterns that start with a wildcard, found by the rarest literal of each."""
    names = cut(derived.table(spark, sf, "requests").select("urn").distinct(), "names")
    globs = cut(derived.table(spark, sf, "globs"), "globs")
    return catalog.covering_assets(names, globs).where("not is_exact").select("urn", F.col("asset_urn").alias("pattern"))


@query(
    "attribute_layering",
    "with " + COVER.strip() + ", layers as (select c.urn, c.is_exact, c.asset_urn, a.zone, a.tier from cover c join {assets} a on a.urn = c.asset_urn),"
    " z as (select urn, arg_max(zone, (is_exact, length(asset_urn), asset_urn)) as region from layers where zone is not null group by 1),"
    " t as (select urn, arg_max(tier, (is_exact, length(asset_urn), asset_urn)) as tier from layers where tier is not null group by 1)"
    " select u.urn, region, tier from urns u left join z using (urn) left join t using (urn)",
)
def attribute_layering(spark: SparkSession, sf: str) -> DataFrame:
    """Broad patterns first, narrower ones over them, the exact asset last."""

    def text(name: str):
        return F.try_variant_get(F.try_element_at("attributes", F.lit(name)), "$", "string").alias(name)

    return _resolved(spark, sf).select("urn", text("region"), text("tier"))


@query("label_merge", "with " + COVER.strip() + " select urn, label, confidence from known")
def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Within an asset the best source wins; across assets the highest confidence."""
    return _resolved(spark, sf).select("urn", F.explode("label_confidence").alias("label", "confidence"))


@query(
    "infer_kind",
    "select event_id, case split_part(urn, '://', 1) when 'pg' then 'table' when 's3' then 'object_store' when 'model' then 'model' when 'mcp' then 'tool' else 'unknown' end as kind,"
    " case event_id % 4 when 0 then 'api' when 1 then 'vector_collection' when 2 then 'unknown' else 'stream' end as other from {requests}",
)
def infer_kind(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.col("event_id") % 4
    other = F.when(pick == 0, "HTTPS://a").when(pick == 1, "qdrant://b").when(pick == 2, "plain").otherwise("kafka://c")
    rows = derived.table(spark, sf, "requests").select("event_id", "urn", other.alias("o"))
    return rows.select(
        "event_id", catalog.infer_kind(F.col("urn")).alias("kind"), catalog.infer_kind(F.col("o")).alias("other")
    )


@query(
    "list_assets",
    "select urn, name from {assets} a where kind = 'object_store' and (urn ilike '%ring%' or name ilike '%ring%' or description ilike '%ring%')"
    " and exists (select 1 from {asset_labels} l where l.urn = a.urn and starts_with(l.label, 'pii.')) order by urn limit 100 offset 2",
)
def list_assets(spark: SparkSession, sf: str) -> DataFrame:
    """A page of assets under kind, label family and free-text filters."""
    page = catalog.list_assets(
        catalog_assets(spark, sf), asset_labels(spark, sf), kind="object_store", label="pii", search="RING", offset=2
    )
    return page.select("urn", "name")


_ASSET_CHANGES = "select concat('s3://', lower(p_type), '/', cast(p_partkey + 50 as string)) as urn, case when p_partkey % 2 = 0 then concat('new ', p_name) end as name, cast(null as string) as owner from {part}"


@query(
    "upsert_assets",
    f"with n as ({_ASSET_CHANGES}), o as (select urn, name, kind, owner from {{assets}})"
    " select urn, coalesce(n.name, o.name, case when o.urn is null then urn end) as name, coalesce(o.kind, 'object_store') as kind, o.owner, o.urn is null as created from o full join n using (urn)",
)
def upsert_assets(spark: SparkSession, sf: str) -> DataFrame:
    """New assets created, known ones changed only in the fields sent."""
    current = catalog_assets(spark, sf).select("urn", "name", "kind", "owner")
    defaults = {"name": F.col("urn"), "kind": catalog.infer_kind(F.col("urn"))}
    return catalog.upsert(current, derived.run(spark, sf, _ASSET_CHANGES), "urn", defaults)


_LABEL_WRITES = "select concat('s3://', lower(p_type), '/', cast(p_partkey as string)) as urn, case p_partkey % 3 when 0 then 'pii.phone' when 1 then 'made.up' else 'pci.iban' end as label, 'scan' as source, cast(p_size as double) / 100 as confidence, p_partkey as written_at from {part} union all select concat('s3://', lower(p_type), '/', cast(p_partkey as string)), 'pii.phone', 'scan', cast(0.99 as double), p_partkey + 1 from {part} where p_partkey % 6 = 0"


@query(
    "set_labels",
    f"with w as ({_LABEL_WRITES}), n as (select urn, label, source, arg_max(confidence, written_at) as confidence from w where label <> 'made.up' group by 1, 2, 3)"
    " select urn, label, source, confidence from n union all select urn, label, source, confidence from {asset_labels} o where not exists (select 1 from n where n.urn = o.urn and n.label = o.label and n.source = o.source)",
)
def set_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Assertions written over, latest first; unknown labels refused."""
    return catalog.set_labels(asset_labels(spark, sf), derived.run(spark, sf, _LABEL_WRITES), at="written_at")


_REMOVALS = "select concat('s3://', lower(p_type), '/', cast(p_partkey as string)) as urn, 'pii.phone' as label, case when p_partkey % 2 = 0 then 'scan' when p_partkey % 3 = 0 then cast(null as string) else 'manual' end as source from {part} where p_size > 20"


@query(
    "remove_labels",
    f"with r as ({_REMOVALS}) select urn, label, source, confidence from {{asset_labels}} l where not exists (select 1 from r where r.urn = l.urn and r.label = l.label and (r.source is null or r.source = l.source))",
)
def remove_labels(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.remove_labels(asset_labels(spark, sf), derived.run(spark, sf, _REMOVALS))


@query(
    "delete_assets",
    "with gone as (select concat('s3://', lower(p_type), '/', cast(p_partkey as string)) as urn from {part} where p_size % 5 = 0)"
    " select 'asset' as what, urn from {assets} where urn not in (select urn from gone) union all select 'label', urn from {asset_labels} where urn not in (select urn from gone)",
)
def delete_assets(spark: SparkSession, sf: str) -> DataFrame:
    gone = derived.run(spark, sf, "select concat('s3://', lower(p_type), '/', cast(p_partkey as string)) as urn from {part} where p_size % 5 = 0")
    assets, labels = catalog.delete_assets(catalog_assets(spark, sf), asset_labels(spark, sf), gone)
    return assets.select(F.lit("asset").alias("what"), "urn").unionByName(labels.select(F.lit("label").alias("what"), "urn"))


_SOURCES = "(select source || '#' || doc_id as id, text, '' as hint from {documents})"
SCANNED = (
    "with " + oracle.scan_ctes(_SOURCES, floor=0.0)
    + f", f as (select 'doc://' || split_part(id, '#', 1) as urn, '/' || split_part(id, '#', 2) as path, s, label, detector, confidence, {oracle.preview_sql('value')} as preview from kept where confidence >= 0.5),"
    " n as (select *, row_number() over (partition by urn, label order by path, s, preview) as rn from f),"
    " p as (select urn, label, path, row_number() over (partition by urn, label order by path) as rn from (select distinct urn, label, path from f) x),"
    " a as (select urn, label, 'scan' as source, max(confidence) as confidence, count(*) as occurrences, string_agg(distinct detector, ' ' order by detector) as detectors from f group by 1, 2),"
    " s3 as (select urn, label, string_agg(preview, ' ' order by rn) as samples from n where rn <= 3 group by 1, 2),"
    " p5 as (select urn, label, string_agg(path, ' ' order by path) as paths from p where rn <= 5 group by 1, 2)"
)


def _source_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = derived.table(spark, sf, "documents").select(
        F.concat(F.lit("doc://"), F.col("source")).alias("urn"),
        F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        "text",
    )
    return catalog.scan_labels(scan.scan(docs, "text", ["urn", "path"]))


@query("scan_labels", SCANNED + " select urn, label, source, confidence, occurrences, detectors, samples, paths from a join s3 using (urn, label) join p5 using (urn, label)")
def scan_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What scanning says about each document source, with masked evidence only."""
    joined = {c: F.array_join(c, " ") for c in ("samples", "detectors", "paths")}
    return _source_scan(spark, sf).withColumns(joined)


@query(
    "apply_scan",
    SCANNED + ", old as (select distinct 'doc://' || source as urn, 'pii.dob' as label, case when n_chars % 2 = 0 then 'manual' else 'scan' end as source from {documents})"
    " select urn, label, source from a union all select urn, label, source from old where source <> 'scan' or urn = 'doc://src3'",
)
def apply_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Scan assertions replaced on scanned assets, everything else left alone."""
    docs = derived.table(spark, sf, "documents")
    old = docs.select(
        F.concat(F.lit("doc://"), F.col("source")).alias("urn"),
        F.lit("pii.dob").alias("label"),
        F.when(F.col("n_chars") % 2 == 0, "manual").otherwise("scan").alias("source"),
    ).distinct()
    done = old.select("urn").where(F.col("urn") != "doc://src3")
    return catalog.apply_scan(old, _source_scan(spark, sf), done).select("urn", "label", "source")


# --------------------------------------------------------------------------- enrichment


def _attr(column: str, name: str, ddl: str = "string"):
    return F.try_variant_get(F.try_element_at(column, F.lit(name)), "$", ddl)


@query(
    "principal_enrichment",
    "select event_id as request_id, case when p.external_id is null then claimed_tier else p.trust_tier end as trust_tier, p.team, p.external_id is not null as registered,"
    " case when p.external_id is not null then not disabled end as enabled, p.display_name from {requests} r left join {principals} p on p.external_id = r.principal_id",
)
def principal_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog attributes laid over the caller's, who cannot promote itself."""
    out = catalog.enrich_principals(access_requests(spark, sf), catalog_principals(spark, sf))
    a = "principal.attributes"
    return out.select(
        "request_id",
        _attr(a, "trust_tier").alias("trust_tier"),
        _attr(a, "team").alias("team"),
        _attr(a, "registered", "boolean").alias("registered"),
        _attr(a, "enabled", "boolean").alias("enabled"),
        _attr(a, "display_name").alias("display_name"),
    )


@query(
    "resource_enrichment",
    "with " + COVER.strip() + ", layers as (select c.urn, c.is_exact, c.asset_urn, a.zone, a.kind from cover c join {assets} a on a.urn = c.asset_urn),"
    " z as (select urn, arg_max(zone, (is_exact, length(asset_urn), asset_urn)) filter (where zone is not null) as region, max(case when is_exact then kind end) as kind from layers group by 1),"
    " l as (select urn, list(label) as labels from known group by 1)"
    " select event_id as request_id, case when event_id % 7 = 0 then 'mine' else region end as region, z.urn is not null as registered,"
    " coalesce(z.kind, case split_part(r.urn, '://', 1) when 'pg' then 'table' when 's3' then 'object_store' when 'model' then 'model' when 'mcp' then 'tool' end) as kind,"
    " array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), case when declared_label is null then [] else [declared_label] end))), ' ') as labels"
    " from {requests} r left join z using (urn) left join l using (urn)",
)
def resource_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """The caller's attributes laid over the catalog's, whose own facts are forced on top."""
    r = access_requests(spark, sf)
    own = F.when(
        F.col("request_id") % 7 == 0,
        F.create_map(F.lit("region"), F.lit("mine").cast("variant"), F.lit("registered"), F.lit("no").cast("variant")),
    )
    r = r.withColumn("resource", F.col("resource").withField("attributes", F.coalesce(own, F.col("resource.attributes"))))
    out = catalog.enrich_resources(r, _resolved(spark, sf))
    a = "resource.attributes"
    return out.select(
        "request_id",
        _attr(a, "region").alias("region"),
        _attr(a, "registered", "boolean").alias("registered"),
        "resource.kind",
        F.array_join("resource.classifications", " ").alias("labels"),
    )


@query("list_principals", "select external_id, display_name from {principals} where type = 'agent' order by external_id limit 900 offset 10")
def list_principals(spark: SparkSession, sf: str) -> DataFrame:
    page = catalog.list_principals(catalog_principals(spark, sf), type_="agent", limit=900, offset=10)
    return page.select("external_id", "display_name")


_PEOPLE = "select case c_custkey % 3 when 0 then concat('agent:', cast(c_custkey as string)) when 1 then concat('user:', cast(c_custkey as string)) else concat('service:', cast(c_custkey as string)) end as external_id, cast(null as string) as type, case when c_custkey % 2 = 0 then upper(c_name) end as display_name from {customer} where c_custkey % 5 = 0"


@query(
    "upsert_principals",
    f"with n as ({_PEOPLE}), o as (select external_id, type, display_name from {{principals}}) select external_id, coalesce(o.type, 'unknown') as type, coalesce(n.display_name, o.display_name) as display_name, o.external_id is null as created from o full join n using (external_id)",
)
def upsert_principals(spark: SparkSession, sf: str) -> DataFrame:
    current = catalog_principals(spark, sf).select("external_id", "type", "display_name")
    return catalog.upsert(current, derived.run(spark, sf, _PEOPLE), "external_id", {"type": F.lit("unknown")})


@query(
    "model_candidates",
    "select urn, name, routable as enabled, coalesce(rank, 1000000) as priority, alias as aliases, coalesce(zone, '') as region from {assets} where kind = 'model'",
)
def model_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Registered models as the router reads them."""
    models = routing.model_table(catalog_assets(spark, sf), asset_labels(spark, sf))
    return models.select(
        "urn",
        "name",
        "enabled",
        "priority",
        F.array_join("aliases", ",").alias("aliases"),
        F.coalesce(F.try_element_at("attributes", F.lit("region")), F.lit("")).alias("region"),
    )


@query("include_exclude", "select urn from {assets} where (starts_with(urn, 's3://') or urn like 'pg://a%.nation_1_') and not (urn like '%7' or starts_with(urn, 's3://small/'))")
def include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Name globs, where exclusion wins."""
    test = catalog.wanted(F.col("urn"), ["s3://*", "pg://a*.nation_1?"], ["*7", "s3://small/*"])
    return catalog_assets(spark, sf).where(test).select("urn")


# --------------------------------------------------------------------------- discovery

_COUNTS = " union all ".join(f"select 'pg://public.{t}' as urn, count(*) as approx_rows from {{{t}}}" for t in derived.BASE)

def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: df for name, df in T.folder_tables(spark, sf).items() if name in derived.BASE}


@query(
    "discover_tables",
    f"select urn, approx_rows, case when urn = 'pg://public.embeddings' then 'vector_collection' else 'table' end as kind from ({_COUNTS}) t",
)
def discover_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of the folder as an asset, with its size."""
    tables = _tables(spark, sf)
    assets, _ = T.discover(spark, tables, "pg://public")
    return assets.join(T.row_counts(tables, "pg://public"), "urn").select("urn", "approx_rows", "kind")


@query("vector_collections", "select 'vec://embeddings' as urn, count(*) as points_count, 'embedding' as vector_name, cast(max(len(embedding)) as int) as vector_size from {embeddings}")
def vector_collections(spark: SparkSession, sf: str) -> DataFrame:
    return T.vector_facts(derived.table(spark, sf, "embeddings"), "vec://embeddings")


_FAKE_COLUMNS = """select concat('t', cast(p_size as string)) as urn, 0 as position,
  case p_partkey % 8 when 0 then 'SSN' when 1 then 'home_email_1' when 2 then 'company' when 3 then 'passport_number' when 4 then 'note' when 5 then 'my_ssn_phone' when 6 then 'social_security_no' else 'x' end as column,
  'string' as type, case p_partkey % 3 when 0 then 'holds phi.mrn, secret' when 1 then '' else 'PII.Dob and pci.iban' end as comment from {part}"""


@query(
    "label_suggestions",
    "with c as (select p_size, p_partkey % 8 as n, p_partkey % 3 as k from {part}), s as ("
    " select p_size, case n when 0 then 'pii.ssn' when 1 then 'pii.email' when 2 then 'pci.card_number' when 3 then 'pii.passport' when 5 then 'pii.ssn' when 6 then 'pii.ssn' end as label from c"
    " union all select p_size, 'phi.mrn' from c where k = 0 and n not in (0, 3) union all select p_size, 'pii.dob' from c where k = 2 and n not in (0, 3) union all select p_size, 'pci.iban' from c where k = 2 and n not in (0, 3))"
    " select distinct concat('t', cast(p_size as varchar)) as urn, label from s where label is not null",
)
def label_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels told by column names and comments."""
    rows = derived.run(spark, sf, _FAKE_COLUMNS.replace(" as column,", " as col_name,"))
    return T.suggested_labels(rows.withColumnRenamed("col_name", "column"))


@query(
    "sampled_read",
    "select o_orderkey, o_orderpriority from {orders} order by md5(cast(o_orderkey as varchar)), o_orderkey limit 200",
)
def sampled_read(spark: SparkSession, sf: str) -> DataFrame:
    """A spread of a table cut to the limit, chosen by a digest of the key so every run agrees."""
    rows = T.sample(derived.table(spark, sf, "orders"), 200, ["o_orderkey"])
    return rows.select("o_orderkey", "o_orderpriority")


@query("sample_columns", "select vec_id, label from {embeddings}")
def sample_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors are never read for a sample."""
    df = derived.table(spark, sf, "embeddings")
    return df.select(*T.sampleable(df))


@query(
    "payload_page",
    "with page as (select vec_id, case when vec_id % 3 = 0 then '' else 'label ' || label end as payload from {embeddings} order by vec_id limit 100)"
    " select vec_id, payload, (select count(*) > 100 from {embeddings}) as partial from page where payload <> ''",
)
def payload_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of non-empty payloads beside vectors that stay unread."""
    payload = F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.concat(F.lit("label "), F.col("label").cast("string")))
    rows = derived.table(spark, sf, "embeddings").select("vec_id", "embedding", payload.alias("payload"))
    return T.payload_page(rows, "payload", ["vec_id"], 100)


def _discovery(spark: SparkSession, sf: str) -> dict:
    """All given tables but one, whole."""
    known = spark.createDataFrame([("pg://public.nation",), ("pg://public.pages",)], "urn string")
    return discovery.run(spark, _tables(spark, sf), "pg://public", known, limit=None, exclude=["*.supplier"])


#: The string columns of the tables; a text of a column is looked at once.
_TEXTS = {
    "region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "part": "p_name p_brand p_type",
    "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "events": "event_type props",
    "documents": "text lang source", "pages": "url html", "benchmark": "text", "conversations": "role text",
}
_EVERY_TEXT = " union all ".join(
    f"select distinct '{t}:{c}:' || md5({c}) as id, {c} as text, '{c}' as hint from {{{t}}} where {c} is not null" for t, cs in _TEXTS.items() for c in cs.split()
)
_PAGE_SCAN = "with " + oracle.scan_ctes(f"({_EVERY_TEXT})", floor=0.0)
_FOUND = _PAGE_SCAN + ", l as (select 'pg://public.' || split_part(id, ':', 1) as urn, string_agg(distinct label, ' ' order by label) as labels from kept where confidence >= 0.5 group by 1)"


@query(
    "discovery_run",
    _FOUND + f", n as (select urn, approx_rows from ({_COUNTS}) x where urn <> 'pg://public.supplier')"
    " select urn, urn not in ('pg://public.nation', 'pg://public.pages') as created, coalesce(labels, '') as labels, approx_rows as records, false as partial from n left join l using (urn)",
)
def discovery_run(spark: SparkSession, sf: str) -> DataFrame:
    """Register tables and label them by scanning; excluded ones are never read."""
    return _discovery(spark, sf)["outcomes"].select(
        "urn",
        "created",
        F.array_join("labels_scanned", " ").alias("labels"),
        F.col("records_sampled").alias("records"),
        F.col("partial_sample").alias("partial"),
    )


@query(
    "discovery_report",
    _PAGE_SCAN + ", f as (select distinct label from kept where confidence >= 0.5), r(key, regulation) as (values "
    + ", ".join(f"('{k}', '{x}')" for k, v in taxonomy.REGULATIONS_OF.items() for x in v)
    + ") select 13 as discovered, 11 as created, 2 as updated, 0 as failed, (select count(distinct split_part(id, ':', 1)) from kept where confidence >= 0.5) as classified,"
    " coalesce((select string_agg(label, ' ' order by label) from f), '') as labels, coalesce((select string_agg(distinct regulation, ' ' order by regulation) from f join r on key = label), '') as regulations",
)
def discovery_report(spark: SparkSession, sf: str) -> DataFrame:
    out = discovery.report(_discovery(spark, sf)["outcomes"])
    return out.withColumns({c: F.array_join(c, " ") for c in ("labels", "regulations")})


@query(
    "asset_scan",
    "with " + oracle.scan_ctes("(select cast(page_id as varchar) as id, html as text, 'html' as hint from {pages})")
    + " select label, max(confidence) as confidence, count(*) as occurrences from kept where confidence >= 0.5 group by 1",
)
def asset_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One asset's rows classified through their schema."""
    pages = derived.table(spark, sf, "pages").select("page_id", F.struct("html").alias("row"))
    found = scan.scan_structured(pages, "row", ["page_id"]).withColumn("urn", F.lit("pg://public.pages"))
    return catalog.scan_labels(found).select("label", "confidence", "occurrences")
