"""The catalog: assets, their labels, principals, and resolving names against them.

Tables: ``assets(urn, name, kind, owner, description, attributes map<string,variant>)``,
``labels(urn, label, source, confidence, ...)``,
``principals(external_id, type, display_name, attributes map<string,variant>, disabled_at)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions import taxonomy
from lakewarden.operators.conditions import glob_regex, glob_regex_column
from lakewarden.operators.scan import preview
from lakewarden.session import cut

# Which source of a label outranks which.
SOURCE_RANK = {"manual": 40, "imported": 30, "scan": 20, "inherited": 10}
# Asset kind by name scheme.
KIND_OF_SCHEME = {
    "pg": "table",
    "postgres": "table",
    "postgresql": "table",
    "mysql": "table",
    "qdrant": "vector_collection",
    "pgvector": "vector_collection",
    "chroma": "vector_collection",
    "weaviate": "vector_collection",
    "s3": "object_store",
    "gs": "object_store",
    "file": "file",
    "mongodb": "collection",
    "kafka": "stream",
    "model": "model",
    "mcp": "tool",
    "http": "api",
    "https": "api",
}
EVIDENCE_SAMPLES = 3
EVIDENCE_PATHS = 5
SCAN_FLOOR = 0.5
#: Characters of a pattern's inner literals that are looked up at once.
GRAM = 8
#: Parts into which the names of one anchor are cut.
SLICES = 16
#: Anchors up to which the planner may copy the index to every task. It judges by the size of the files that
#: patterns come from, not by the anchors and slices made of them.
FEW_ANCHORS = 4096

ATTRIBUTES = "map<string,variant>"


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def infer_kind(urn: Column) -> Column:
    scheme = F.when(F.contains(urn, F.lit("://")), F.lower(F.substring_index(urn, "://", 1)))
    return _lookup(KIND_OF_SCHEME, F.coalesce(scheme, F.lit("")), F.lit("unknown"))


def source_rank(source: Column) -> Column:
    return _lookup(SOURCE_RANK, source, F.lit(0))


# --------------------------------------------------------------------------- resolving


def merged_labels(labels: DataFrame) -> DataFrame:
    """One confidence per (asset, label): that of the highest-ranking source."""
    best = F.max_by("confidence", F.struct(source_rank(F.col("source")), F.col("confidence")))
    return labels.groupBy("urn", "label").agg(best.alias("confidence"))


def _windows(text: Column, size: Column) -> Column:
    """All runs of ``size`` characters of ``text``, which has at least as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size))


def _at(place: str) -> Callable[[Column], Column]:
    return lambda text: F.struct(F.lit(place).alias("place"), text.alias("text"))


def anchors(pattern: Column) -> Column:
    """``array<struct<place, text>>``: texts of which every name that a glob covers holds each.

    These are the glob's literal beginning and end and, of the pieces between wildcards, every run of
    ``GRAM`` characters, or the piece itself if it is shorter. A glob of wildcards alone has the empty
    beginning, which every name holds.
    """
    pieces = F.split(F.regexp_replace(pattern, r"\[[^\]]+\]", "*"), r"[*?]+")
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: x != "")
    grams = F.flatten(F.transform(inner, lambda x: _windows(x, F.least(F.length(x), F.lit(GRAM)))))
    ends = F.array(_at("start")(F.element_at(pieces, 1)), _at("end")(F.element_at(pieces, -1)))
    found = F.array_distinct(F.concat(F.filter(ends, lambda x: x["text"] != ""), F.transform(grams, _at("inside"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(_at("start")(F.lit(""))))


def _held(name: Column, sizes: dict[str, list[int]]) -> Column:
    """The anchors that a name may answer to, of the given sizes only."""
    take = {
        "start": lambda n: F.array(F.left(name, n)),
        "end": lambda n: F.array(F.right(name, n)),
        "inside": lambda n: _windows(name, n),
    }
    none = F.array().cast("array<struct<place:string,text:string>>")
    parts = [none]
    for place, lengths in sizes.items():
        fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(name))
        texts = F.array_distinct(F.flatten(F.transform(fitting, take[place])))
        parts.append(F.transform(texts, _at(place)))
    return F.concat(*parts)


def _sizes(found: DataFrame) -> tuple[dict[str, list[int]], int]:
    """The distinct lengths of anchors by place, as many numbers as the longest pattern has characters at most, and how many anchors there are."""
    out: dict[str, list[int]] = {}
    rows = sorted(found.groupBy("place", F.length("text")).count().collect())
    for place, n, _ in rows:
        out.setdefault(place, []).append(n)
    return out, sum(r[2] for r in rows)


def covering_assets(urns: DataFrame, assets: DataFrame, slices: int = SLICES) -> DataFrame:
    """``(urn, asset_urn, is_exact)``: the asset itself and every pattern asset covering it.

    Patterns are posted in an inverted index under one of their literals each: the one that the fewest
    names hold, be it the beginning, the end or a run of characters between. Names look up their own
    beginnings, ends and runs, of those lengths only that the index has, and what meets is tested as a
    glob. An anchor that many names hold is cut into ``slices`` by the name; patterns are repeated in
    each, so this should be a small number. ``urns`` and ``assets`` are read several times and had
    better be written tables; a null name is covered by nothing.
    """
    names = urns.select("urn").where(F.col("urn").isNotNull()).distinct()
    known = assets.select(F.col("urn").alias("asset_urn")).distinct()
    exact = names.join(known.hint("merge"), F.col("urn") == F.col("asset_urn")).select("urn", "asset_urn", F.lit(True).alias("is_exact"))
    patterns = known.where(F.col("asset_urn").rlike(r"[*?]"))
    choices = patterns.select("asset_urn", F.inline(anchors(F.col("asset_urn"))))
    sizes, many = _sizes(choices)
    index = (lambda df: df) if many <= FEW_ANCHORS else (lambda df: df.hint("merge"))
    held = names.select("urn", F.inline(_held(F.col("urn"), sizes)))
    held = held.join(index(choices.select("place", "text").distinct()), ["place", "text"], "left_semi")
    if many > FEW_ANCHORS:
        # Most of what names hold is in no pattern; only the rest is counted and looked up.
        held = cut(held, "held")
    asked = held.groupBy("place", "text").agg(F.count("*").alias("many"))
    # No name holds an anchor that none was counted for, so its pattern covers none.
    rarest = (
        choices.join(index(asked), ["place", "text"], "left")
        .groupBy("asset_urn")
        .agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "place", "text")).alias("best"))
        .where("best.many > 0")
    )
    posted = rarest.select(
        "asset_urn",
        "best.place",
        "best.text",
        glob_regex_column(F.col("asset_urn")).alias("glob"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    by_glob = (
        held.withColumn("slice", F.pmod(F.xxhash64("urn"), F.lit(slices)).cast("int"))
        .join(index(posted), ["place", "text", "slice"])
        .where((F.col("urn") != F.col("asset_urn")) & F.expr("urn rlike glob"))
        .select("urn", "asset_urn", F.lit(False).alias("is_exact"))
    )
    return exact.unionByName(by_glob)


def resolve(urns: DataFrame, assets: DataFrame, labels: DataFrame) -> DataFrame:
    """Everything the catalog knows about each distinct ``urn``.

    Labels take the highest confidence over the covering assets. Attributes are layered by
    key: shorter patterns first, the exact asset last. A name gathers only the assets that
    cover it, so a row's array is bounded by the patterns of the catalog.

    ``urns``, ``assets`` and ``labels`` are read once each: the distinct names and the catalog with
    its labels are written to the shared folder when the plan is built, and so is the answer.
    """
    names = cut(urns.select("urn").where(F.col("urn").isNotNull() & (F.col("urn") != "")).distinct(), "names")
    labelled = merged_labels(labels).groupBy(F.col("urn").alias("asset_urn")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "confidence")))).alias("labels")
    )
    known = cut(assets.select(F.col("urn").alias("asset_urn"), "attributes", "kind").join(labelled, "asset_urn", "left"), "catalog")
    no_labels = F.create_map().cast("map<string,double>")
    layer = F.struct(
        "is_exact",
        F.length("asset_urn").alias("size"),
        "asset_urn",
        "kind",
        F.coalesce("attributes", F.create_map().cast(ATTRIBUTES)).alias("attributes"),
        F.coalesce("labels", no_labels).alias("labels"),
    )
    # Attributes have no order of their own, so layers are ordered by their place alone.
    covered = (
        covering_assets(names, known.select(F.col("asset_urn").alias("urn")))
        .join(known, "asset_urn")
        .groupBy("urn")
        .agg(F.collect_list(layer).alias("found"))
        .withColumn("layers", F.array_sort("found", _by_place))
    )
    rows = names.join(covered, "urn", "left").withColumn(
        "layers", F.coalesce("layers", F.array().cast(covered.schema["layers"].dataType))
    )
    exact = F.get(F.filter("layers", lambda x: x["is_exact"]), F.lit(0))
    higher = F.aggregate(
        "layers",
        no_labels,
        lambda acc, x: F.map_zip_with(acc, x["labels"], lambda k, a, b: F.greatest(a, b)),
    )
    resolved = rows.select(
        "urn",
        (F.size("layers") > 0).alias("registered"),
        F.coalesce(exact["kind"], infer_kind(F.col("urn"))).alias("kind"),
        higher.alias("label_confidence"),
        F.transform(F.filter("layers", lambda x: ~x["is_exact"]), lambda x: x["asset_urn"]).alias("matched_patterns"),
        F.aggregate(
            "layers", F.create_map().cast(ATTRIBUTES), lambda acc, x: overlay(acc, x["attributes"])
        ).alias("attributes"),
    )
    return cut(resolved, "resolved")


def _by_place(a: Column, b: Column) -> Column:
    left = F.struct(a["is_exact"], a["size"], a["asset_urn"])
    right = F.struct(b["is_exact"], b["size"], b["asset_urn"])
    return F.when(left < right, F.lit(-1)).when(left > right, F.lit(1)).otherwise(F.lit(0))


# --------------------------------------------------------------------------- merging maps


def overlay(base: Column, top: Column) -> Column:
    """Both maps as one; the keys of ``top`` win."""
    none = F.create_map().cast(ATTRIBUTES)
    base, top = F.coalesce(base, none), F.coalesce(top, none)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def as_variant(value: Column) -> Column:
    return value.cast("variant")


def facts(**values: Column) -> Column:
    """A variant map of named values."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), as_variant(v))])


def enrich_principals(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """Lay catalog attributes over the caller's; the catalog wins.

    Whether the catalog side is broadcast is left to its size.
    """
    known = principals.select(
        F.col("external_id").alias("_pid"),
        F.col("attributes").alias("_known"),
        F.col("display_name").alias("_display"),
        F.col("disabled_at").isNull().alias("_enabled"),
    )
    joined = requests.join(known, F.col("principal.id") == F.col("_pid"), "left")
    registered = F.col("_pid").isNotNull()
    # What is read more than once is a column first, or the optimizer's plan would build it again each time.
    joined = joined.withColumn("_merged", overlay(F.col("principal.attributes"), F.col("_known")))
    merged = F.col("_merged")
    named = F.when(
        F.map_contains_key(merged, F.lit("display_name")), merged
    ).otherwise(F.map_concat(merged, facts(display_name=F.col("_display"))))
    status = F.when(registered, facts(registered=registered, enabled=F.col("_enabled"))).otherwise(
        facts(registered=registered)
    )
    joined = joined.withColumn("_status", status)
    attributes = overlay(F.when(registered, named).otherwise(merged), F.col("_status"))
    return joined.withColumn("principal", F.col("principal").withField("attributes", attributes)).drop(
        "_pid", "_known", "_display", "_enabled", "_merged", "_status"
    )


def enrich_resources(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Lay the caller's attributes over the catalog's; the caller wins here.

    ``registered`` and ``matched_patterns`` always come from the catalog.
    """
    known = resolved.select(
        F.col("urn").alias("_urn"),
        F.col("registered").alias("_registered"),
        F.col("kind").alias("_kind"),
        F.map_keys("label_confidence").alias("_labels"),
        F.col("matched_patterns").alias("_patterns"),
        F.col("attributes").alias("_attributes"),
    )
    joined = requests.join(known, F.col("resource.urn") == F.col("_urn"), "left")
    none = F.array().cast("array<string>")
    forced = facts(
        registered=F.coalesce("_registered", F.lit(False)),
        matched_patterns=F.coalesce("_patterns", none),
    )
    joined = joined.withColumn("_forced", forced)
    merged = overlay(overlay(F.col("_attributes"), F.col("resource.attributes")), F.col("_forced"))
    labels = F.array_sort(
        F.array_union(F.coalesce("_labels", none), F.coalesce("resource.classifications", none))
    )
    resource = F.struct(
        F.col("resource.urn").alias("urn"),
        F.coalesce(F.nullif(F.col("resource.kind"), F.lit("")), F.nullif(F.col("_kind"), F.lit(""))).alias("kind"),
        labels.alias("classifications"),
        merged.alias("attributes"),
    )
    return joined.withColumn("resource", resource).drop(
        "_urn", "_registered", "_kind", "_labels", "_patterns", "_attributes", "_forced"
    )


# --------------------------------------------------------------------------- keeping it


def list_assets(
    assets: DataFrame,
    labels: DataFrame | None = None,
    kind: str | None = None,
    owner: str | None = None,
    label: str | None = None,
    search: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """Assets by name; ``label`` takes a family, ``search`` looks in three columns.

    ``limit=None`` lists everything.
    """
    out = assets
    if kind:
        out = out.where(F.col("kind") == kind)
    if owner:
        out = out.where(F.col("owner") == owner)
    if search:
        wanted = f"%{search}%"
        out = out.where(
            F.col("urn").ilike(wanted) | F.col("name").ilike(wanted) | F.col("description").ilike(wanted)
        )
    if label and labels is not None:
        covered = sorted(taxonomy.expand(label) or {label})
        out = out.join(labels.where(F.col("label").isin(*covered)), "urn", "left_semi")
    if limit is None:
        return out
    return out.orderBy("urn").offset(max(0, offset)).limit(limit)


def upsert(current: DataFrame, changes: DataFrame, key: str, defaults: dict[str, Column] | None = None, at: str | None = None) -> DataFrame:
    """Current rows with the supplied (non-null) fields of ``changes`` laid over them.

    ``created`` tells new rows. ``defaults`` fill fields a new row leaves out. Several changes of one
    key become one: of each field the value sent last by ``at``, or any one value without it.
    """
    fields = [c for c in current.columns if c != key]
    sent = [c for c in fields if c in changes.columns]
    pick = lambda c: F.first(c, ignorenulls=True) if at is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    new = changes.groupBy(key).agg(F.lit(True).alias("_sent"), *[pick(c).alias(f"_new_{c}") for c in sent])
    old = current.withColumn("_kept", F.lit(True))
    joined = old.join(new, key, "full_outer")
    created = F.col("_kept").isNull()

    def value(c: str) -> Column:
        sent = F.col(f"_new_{c}") if c in changes.columns else F.lit(None)
        fill = (defaults or {}).get(c)
        kept = F.col(c) if fill is None else F.coalesce(F.col(c), F.when(created, fill))
        return F.coalesce(sent, kept).alias(c)

    return joined.select(key, *[value(c) for c in fields], created.alias("created"))


def set_labels(current: DataFrame, writes: DataFrame, at: str = "at") -> DataFrame:
    """Latest assertion per (asset, label, source). Unknown labels are refused, not stored."""
    known = writes.where(F.col("label").isin(*taxonomy.SEVERITY_OF))
    newest = known.groupBy("urn", "label", "source").agg(F.max_by(F.struct(*[c for c in known.columns if c not in ("urn", "label", "source")]), at).alias("w"))
    fresh = newest.select("urn", "label", "source", "w.*").drop(at)
    kept = current.join(fresh, ["urn", "label", "source"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def refused_labels(writes: DataFrame) -> DataFrame:
    return writes.where(~F.col("label").isin(*taxonomy.SEVERITY_OF))


def remove_labels(labels: DataFrame, removals: DataFrame) -> DataFrame:
    """Without the removed assertions; a removal with a null source takes every source."""
    some = removals.where(F.col("source").isNotNull()).select("urn", "label", "source")
    every = removals.where(F.col("source").isNull()).select("urn", "label")
    return labels.join(some, ["urn", "label", "source"], "left_anti").join(every, ["urn", "label"], "left_anti")


def delete_assets(assets: DataFrame, labels: DataFrame, urns: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = urns.select("urn")
    return assets.join(gone, "urn", "left_anti"), labels.join(gone, "urn", "left_anti")


def scan_labels(findings: DataFrame, min_confidence: float = SCAN_FLOOR) -> DataFrame:
    """What a scan says about each asset: best confidence and masked evidence per label.

    ``findings`` is ``(urn, path, start, label, detector, value, confidence)``. Counts and
    the evidence are kept by partial aggregates of fixed size, so an asset holding a third
    of all findings costs no more memory than any other. Findings are written once to the shared
    folder, masked, so that the text is scanned a single time.
    """
    strong = findings.where(F.col("confidence") >= min_confidence).withColumn("preview", preview(F.col("value")))
    strong = cut(strong.select("urn", "label", "path", "start", "detector", "confidence", "preview"), "findings")
    place = F.struct(F.col("path"), F.col("start"), F.col("preview"))
    totals = strong.groupBy("urn", "label").agg(
        F.max("confidence").alias("confidence"),
        F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set("detector")).alias("detectors"),
    )
    samples = _first_per_group(strong.select("urn", "label", place.alias("item")), EVIDENCE_SAMPLES).agg(
        F.transform(F.array_sort(F.collect_list("item")), lambda p: p["preview"]).alias("samples")
    )
    paths = _first_per_group(
        strong.where(F.col("path") != "").select("urn", "label", F.col("path").alias("item")).distinct(),
        EVIDENCE_PATHS,
    ).agg(F.array_sort(F.collect_list("item")).alias("paths"))
    return (
        totals.join(samples, ["urn", "label"], "left")
        .join(paths, ["urn", "label"], "left")
        .select(
            "urn",
            "label",
            F.lit("scan").alias("source"),
            "confidence",
            "occurrences",
            "samples",
            "detectors",
            F.coalesce("paths", F.array().cast("array<string>")).alias("paths"),
        )
    )


def _first_per_group(rows: DataFrame, n: int, salts: int = 64):
    """The ``n`` smallest items per (urn, label), thinned inside salted slices first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    inner = Window.partitionBy("urn", "label", "_salt").orderBy("item")
    thin = salted.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= n)
    outer = Window.partitionBy("urn", "label").orderBy("item")
    return thin.withColumn("_n", F.row_number().over(outer)).where(F.col("_n") <= n).groupBy("urn", "label")


def apply_scan(labels: DataFrame, scanned: DataFrame, assets: DataFrame) -> DataFrame:
    """Replace the scan assertions of the scanned assets; all other sources stay.

    ``assets`` names what was scanned, since a clean scan leaves no rows in ``scanned``.
    """
    stale = labels.where(F.col("source") == "scan").join(assets.select("urn"), "urn", "left_semi")
    kept = labels.join(stale.select("urn", "label", "source"), ["urn", "label", "source"], "left_anti")
    return kept.unionByName(scanned.select(*[c for c in scanned.columns if c in labels.columns]), allowMissingColumns=True)


def list_principals(principals: DataFrame, type_: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page of principals; ``limit=None`` lists everything."""
    out = principals.where(F.col("type") == type_) if type_ else principals
    return out if limit is None else out.orderBy("external_id").offset(max(0, offset)).limit(limit)


def wanted(urn: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Include and exclude globs; exclusion wins and no includes means all."""

    def any_of(globs: Iterable[str]) -> Column:
        test = F.lit(False)
        for g in globs:
            test = test | urn.rlike(glob_regex(g))
        return test

    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))
