"""URL rules and their spread over redirects.

A rule is a host and the beginning of a path. It fits a URL if the URL's host is the rule's or lies
below it and the path starts with the rule's; the longest fitting rule decides. A URL that no rule
fits takes the verdict of its aliases: URLs joined by redirects (a refresh tag) and canonical links,
over any number of steps, are one component. One explicitly allowed member allows all the others,
else one explicitly blocked member blocks them, else they are allowed. Explicit verdicts stay.

Only DataFrame functions: rules are found by an equi-join on the host's suffixes, components by
alternating stars over tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common
from lakewarden.session import cut

#: Rules as the contract has them (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ATTR = r"""\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return (
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
        F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1),
    )


def query(url: Column) -> Column:
    """The query of a URL with its question mark; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]+)", 1)


def vertex(host: Column, path: Column, asked: Column) -> Column:
    """One spelling for URLs that differ by scheme, fragment, ``www.`` or a closing slash; ``asked`` is the query."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(?:/|/index\.html?)$", ""), asked)


def targets(html: Column) -> Column:
    """Addresses that a page names as its canonical form or sends its reader to."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\s[^>]*(?:canonical|refresh)[^>]*>"), F.lit(0))
    href = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<link\s") & t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b""")),
        lambda t: F.regexp_extract(t, r"(?i)\shref" + _ATTR, 1),
    )
    sent = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\s") & t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    found = F.filter(F.concat(href, sent), lambda t: t != "")
    # Most pages name neither; the cheap test spares them the tag search.
    return F.when(F.lower(html).rlike("canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def without_dots(path: Column) -> Column:
    """``path`` with the steps ``.`` and ``..`` taken."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x))),
    )
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(taken) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(taken, "/"), folder)).otherwise(path)


def absolute(target: Column, url: Column, host: Column, path: Column) -> Column:
    """``target`` as seen from the page ``url`` with this host and path; empty if its scheme names no host."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), F.regexp_extract(target, r"^(//[^/?#]*)", 1)))
        .otherwise(F.concat(scheme, F.lit("://"), host))
    )
    named = target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")
    rest = F.regexp_replace(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    own = F.regexp_extract(rest, r"^([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    whole = F.when(named | own.startswith("/"), own).when(own == "", path).otherwise(F.concat(folder, own))
    asked = F.when(named | (own != "") | rest.contains("?"), query(rest)).otherwise(query(url))
    return F.when(origin == "", "").otherwise(F.concat(origin, without_dots(whole), asked))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (row, host, path, ...) with the longest fitting rule and its verdict, or nulls."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1 << 30), "."))
    fits = (
        urls.select("row", "path", F.explode(suffixes).alias("rule_host"))
        .where("rule_host <> ''")
        .join(rules, "rule_host")
        .where("startswith(path, rule_path)")
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    return urls.join(best.select("row", "best.rule", "best.rule_verdict"), "row", "left")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row for each row of ``pages``.

    A null URL or one without ``://`` has an empty host and path, fits no rule, has no aliases and is
    allowed. A null page names no aliases. Repeated rows come back as often as they came; two rules
    of one length and spelling resolve to the later verdict in the alphabet, block. Other columns
    are ignored.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    else:
        rules = rules.toDF("rule_host", "rule_path", "rule_verdict")
    url = F.col(url_col)
    host, path = host_and_path(url)
    seen = cut(
        pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"), targets(F.col(html_col)).alias("targets"))
        .select("page_id", "url", "host", "path", F.when(F.col("host") != "", vertex(F.col("host"), F.col("path"), query(F.col("url")))).alias("vertex"), "targets")
        .withColumn("row", F.monotonically_increasing_id()),
        "pages",
    )
    there = (
        seen.where("vertex is not null")
        .select("vertex", F.explode("targets").alias("target"), "url", "host", "path")
        .select("vertex", absolute(F.col("target"), F.col("url"), F.col("host"), F.col("path")).alias("to"))
        .select("vertex", "to", *(c.alias(n) for c, n in zip(host_and_path(F.col("to")), ("host", "path"), strict=True)))
        .where("host <> ''")
        .withColumn("alias", vertex(F.col("host"), F.col("path"), query(F.col("to"))))
    )
    groups = common.components(there.select("vertex", "alias"))
    # Addresses that are only pointed at carry explicit verdicts too; a spelling is judged once.
    spelled = seen.where("vertex is not null").select("vertex", "host", "path").union(there.select("alias", "host", "path")).distinct()
    explicit = judged(spelled.withColumn("row", F.concat_ws("\n", "vertex", "host", "path")), rules).where("rule is not null")
    group = F.coalesce("component", "vertex")
    spread = (
        explicit.join(groups.withColumnRenamed("id", "vertex"), "vertex", "left")
        .groupBy(group.alias("group"))
        .agg(F.min("rule_verdict").alias("spread"))  # allow precedes block
    )
    return (
        judged(seen.select("row", "page_id", "host", "path", "vertex"), rules)
        .join(groups.withColumnRenamed("id", "vertex"), "vertex", "left")
        .withColumn("group", group)
        .join(spread, "group", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"))
    )
