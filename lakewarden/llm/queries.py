"""The numbered queries, each its operator over a whole given table, and their SQL on DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Components over links (a > b) in SQL: every vertex reaches the smallest id over any chain of links.
_REACH = """
both_ways as (select a, b from link union select b, a from link),
reach(a, b) as (select a, a from both_ways union select r.a, l.b from reach r join both_ways l on l.a = r.b),
component as (select a as id, min(b) as component_id from reach group by a)
"""


@register
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


ORACLES["op1_minhash_near_dedup"] = f"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') as w from documents),
shingle as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from split),
size as (select doc_id, count(*) as n from shingle group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingle x join shingle y on x.s = y.s and x.doc_id > y.doc_id group by all),
link as (select a, b from common join size p on p.doc_id = a join size q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
{_REACH}
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from documents d left join size s on s.doc_id = d.doc_id left join component c on c.id = d.doc_id
"""


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Base places by position, notices by 3-grams on diagonals, merged as the operator merges them."""
    from lakewarden.llm import licenses

    said = [*licenses.BASE.items(), *licenses.NOTICES.items()]
    read = [(*licenses.parsed(text), label) for text, label in said]
    rows = ", ".join(
        f"({n}, '{' '.join(words)}', {[i for i in range(len(words)) if need >> i & 1]}::bigint[], '{label}', {str(n < len(licenses.BASE)).lower()})"
        for n, (words, need, label) in enumerate(read)
    )
    return f"""
    with template(template, phrase, need, label, is_base) as (values {rows}),
    gram as (select template, need, label, is_base, len(p) - 2 as grams, unnest(range(1, len(p) - 1)) as k, p
        from (select *, string_split(phrase, ' ') as p from template)),
    known as (select template, need, label, is_base, grams, k - 1 as place, p[k] || ' ' || p[k + 1] || ' ' || p[k + 2] as g from gram),
    said as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
    place as (select r, unnest(range(1, len(w) - 1)) as i, w from said),
    hit as (select distinct r, template, need, label, is_base, grams, i - 1 - place as diagonal, place
        from (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from place) join known using (g)),
    vote as (select r, template, need, label, is_base, grams, diagonal, list(place) as places, count(*) = any_value(grams) and bool_and(is_base) as whole
        from hit group by r, template, need, label, is_base, grams, diagonal),
    opened as (select *, case when diagonal - lag(diagonal) over (partition by r, template order by diagonal) <= {licenses.SLACK} then 0 else 1 end as opens from vote),
    run as (select *, sum(opens) over (partition by r, template order by diagonal) as run from opened),
    merged as (select r, template, label, is_base, run,
        case when list_has_all(flatten(list(places)), any_value(need)) then len(list_distinct(flatten(list(places)))) / any_value(grams) else 0 end as covered,
        count(*) filter (whole) as whole, min(diagonal) filter (whole) as low, max(diagonal) filter (whole) as high from run group by r, template, label, is_base, run),
    found as (select r, sum(whole)::bigint as n_base, min(low) as first_word, max(high) as last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (whole > 0), '') as base_labels,
        coalesce(string_agg(distinct label, ',' order by label) filter (whole > 0 or (not is_base and covered >= {licenses.COVER})), '') as labels,
        max(case when is_base then (whole > 0)::int::double else covered end) as score from merged group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
        coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
    from said left join found using (r)
    """


ORACLES["op2_license_scan"] = _license_sql()


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents"))


ORACLES["op4_substring_dedup"] = """
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
place as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from split),
win as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from place),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as k from late),
each as (select doc_id, k, w[k] as word from (select doc_id, unnest(range(1, len(w) + 1)) as k, w from split)),
kept as (select e.doc_id, count(*) as n, string_agg(word, ' ' order by e.k) as t from each e anti join gone g on g.doc_id = e.doc_id and g.k = e.k group by all)
select s.doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from split s left join kept k on k.doc_id = s.doc_id
"""


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import pii

    return pii.pseudonymize(table(spark, sf_dir, "documents"), b"op8-example-key")


@register
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import urls

    return urls.filter_urls(table(spark, sf_dir, "pages"))


ORACLES["op9_url_filter"] = f"""
with recursive seen as (
    select row_number() over () as r, page_id, html, url, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1) as scheme,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) as path, regexp_extract(coalesce(url, ''), '(?s)^[^?#]*(\\?[^#]+)', 1) as asked from pages),
tag as (select r, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\\s[^>]*(?:canonical|refresh)[^>]*>')) as t from seen),
target as (
    select r, regexp_extract(t, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1) as t from tag
        where regexp_matches(t, '(?i)^<link\\s') and regexp_matches(t, '(?i)\\srel\\s*=\\s*["'']?canonical\\b')
    union all select r, regexp_extract(t, '(?i)[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1) from tag
        where regexp_matches(t, '(?i)^<meta\\s') and regexp_matches(t, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b')),
told as (select r, replace(t, '&amp;', '&') as t from target where t <> ''),
read as (select r, regexp_matches(t, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') as named, regexp_replace(t, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', '') as rest,
    case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)
        when starts_with(t, '//') then scheme || ':' || regexp_extract(t, '^(//[^/?#]*)', 1) else scheme || '://' || host end as origin,
    host, path, asked from told join seen using (r) where host <> ''),
whole as (select r, origin, regexp_extract(rest, '^([^?#]*)', 1) as own,
    case when named or starts_with(own, '/') then own when own = '' then path else case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end || own end as p,
    case when named or own <> '' or contains(rest, '?') then regexp_extract(rest, '(?s)^[^?#]*(\\?[^#]+)', 1) else asked end as asked from read where origin <> ''),
stepped as (select r, origin, asked, p, list_reduce(list_transform(string_split(p, '/')[2:], lambda x: [x]),
    lambda held, x: case when x[1] = '..' then held[1:greatest(len(held) - 1, 0)] when x[1] = '.' then held else held || x end, []::varchar[]) as taken from whole),
addr as (select r, asked, origin || case when regexp_matches(p, '/\\.\\.?(?:/|$)')
    then '/' || array_to_string(taken, '/') || case when regexp_matches(p, '/\\.\\.?$') and len(taken) > 0 then '/' else '' end else p end || asked as u from stepped),
there as (select r, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) as path, asked from addr),
named as (select *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(?:/|/index\\.html?)$', '') || asked as v from
    (select r, true as own, host, path, asked from seen union all select r, false, host, path, asked from there) where host <> ''),
link as (select distinct p.v as a, q.v as b from named p join named q on p.r = q.r and p.own and not q.own and p.v <> q.v),
{_REACH},
rule(rule_host, rule_path, says) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(says, length(rule_host || rule_path)) as says
    from (select distinct host, path from named) join rule on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by all),
spread as (select coalesce(component_id, v) as g, min(says) as says from named join best using (host, path) left join component on id = v group by g)
select page_id, s.host, s.path, rule, coalesce(b.says, p.says, 'allow') as verdict
from seen s left join named n on n.r = s.r and own left join component c on c.id = n.v
left join best b on b.host = s.host and b.path = s.path left join spread p on p.g = coalesce(component_id, n.v)
"""


@register
def op10_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"))


@register
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import neardup_vectors

    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op3_embedding_near_dedup"] = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
fine as (select *, sqrt(list_dot_product(e, e)) as n from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select x.vec_id as a, y.vec_id as b from fine x join fine y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id > y.vec_id
    where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
{_REACH},
n as (select a as id, count(*) as n from both_ways group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join n on n.id = vec_id left join component c on c.id = vec_id
"""


@register
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import permutations

    return permutations.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import align

    return align.align(table(spark, sf_dir, "documents"))


@register
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, least_words=20, percent=5, seed=42)


def _nibbles() -> list[int]:
    """The steps of CRC-32 for four bits at a time, from its reversed polynomial."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


#: n-grams once per distinct one, their CRC by a fold over the hexadecimal digits of their bytes.
ORACLES["op12_importance_resample"] = f"""
with text(side, doc_id, t) as (select 0, doc_id, text from documents union all select 1, row_number() over (), text from benchmark),
split as (select side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from text),
gram as (select side, doc_id, unnest([array_to_string(w[i:i + k], ' ') for i in range(1, len(w) - k + 1)]) as g from split, (values (0), (1), (2)) s(k)),
held as (select side, doc_id, g, count(*) as n from gram group by all),
code as (select g, xor(list_reduce([instr('123456789ABCDEF', d)::bigint for d in string_split(regexp_replace(hex(encode(g)), '(.)(.)', '\\2\\1', 'g'), '')],
    lambda c, d: xor(c >> 4, list_extract({_nibbles()}, (xor(c, d) & 15) + 1)), 4294967295::bigint), 4294967295) % 10000 as bucket from (select distinct g from held)),
own as (select side, doc_id, bucket, sum(n)::bigint as n from held join code using (g) group by all),
total as (select side, sum(n)::bigint as n from own group by side),
gain as (select bucket, floor(1000 * ln(((t + 1) * (big_s + 10000))::double / ((s + 1) * (big_t + 10000))::double))::bigint as gain
    from (select bucket, coalesce(sum(n) filter (side = 0), 0)::bigint as s, coalesce(sum(n) filter (side = 1), 0)::bigint as t from own group by bucket),
    (select coalesce(max(n) filter (side = 0), 0) as big_s, coalesce(max(n) filter (side = 1), 0) as big_t from total)),
weighed as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from own join gain using (bucket) where side = 0 group by doc_id),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from split left join weighed using (doc_id) where side = 0),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as many from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * many // 100 then place end as rank from placed
"""


@register
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm import token_counts

    return token_counts.counts(table(spark, sf_dir, "documents"), limit=1024)
