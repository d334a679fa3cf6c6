"""Operator 5, URL filters with redirect equivalence. DataFrame functions only.

Rules judge a URL by its host and path. URLs that no rule fits get the decision of their aliases: pages name aliases by
canonical links and by refresh redirects, and a table of redirects may add more. Connected components over these
edges are found by distributed star contraction. A component with a blocked member blocks its others, unless a member is
explicitly allowed; a URL without a blocked alias is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written
from .components import connected_components

#: (verdict, host, path) of the contract's rules (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<link\b[^>]*>"
_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?i)<meta\b[^>]*>"
_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def key_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query; null where there is no host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], of_rule) -> Column:
    """Of the longest rule that fits; rules are a short list, so this is a projection and no join."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(of_rule(v, h, p))) for v, h, p in ordered]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def rule_name(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    return _rule(host, path, rules, lambda v, h, p: h + p)


def rule_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    return _rule(host, path, rules, lambda v, h, p: v)


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) of every canonical link and refresh redirect, resolved against the page's own URL."""
    u, h = F.col(url), F.coalesce(F.col(html), F.lit(""))
    canonical = F.transform(F.filter(F.regexp_extract_all(h, F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.filter(F.regexp_extract_all(h, F.lit(_META), F.lit(0)), lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(t, _TARGET, 1))
    found = pages.filter(u.isNotNull()).select(u.alias("from_url"), F.explode(F.concat(canonical, refresh)).alias("t"))
    t = F.replace(F.col("t"), F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract("from_url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("from_url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    to = (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(folder, t))
    )
    return found.filter("t <> ''").select("from_url", to.alias("to_url"))


def url_filter(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    *,
    url: str = "url",
    html: str | None = "html",
    keep: list[str] | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """A row per row of pages: ``row`` (a struct of the columns ``keep``, or of all), host, path, rule and verdict.

    redirects holds further edges as from_url and to_url. Defined results: a null url or one without ``://`` has an
    empty host and path, no rule and no alias, and is allowed; an edge to a URL that is no page still counts, as does a
    rule that fits it; edges with a null end are skipped; repeated pages repeat; an empty table gives an empty result;
    other columns stay inside ``row``.
    """
    edges = alias_edges(pages, url=url, html=html) if html else None
    if redirects is not None:
        more = redirects.select("from_url", "to_url")
        edges = more if edges is None else edges.unionByName(more)
    row = F.struct(*[pages[c] for c in (keep or pages.columns)]).alias("row")
    out = pages.select(row, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), key_of(pages[url]).alias("key"))
    out = out.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).withColumn("own", rule_verdict(F.col("host"), F.col("path"), rules))
    if edges is None:
        return out.select("row", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    ends = lambda c: F.struct(key_of(F.col(c)).alias("key"), rule_verdict(host_of(F.col(c)), path_of(F.col(c)), rules).alias("own"))
    keyed = written(edges.select(ends("from_url").alias("a"), ends("to_url").alias("b")).distinct(), "url-edges")
    roots = connected_components(keyed.select("a.key", F.col("b.key").alias("to")), "key", "to")
    nodes = keyed.select("a.*").unionByName(keyed.select("b.*")).filter("key is not null").distinct()
    told = nodes.join(roots, nodes["key"] == roots["node"]).select("key", "root", "own")
    blocked = told.groupBy("root").agg(F.max(F.col("own") == "block").alias("block"), F.max(F.col("own") == "allow").alias("allow"))
    blocked = blocked.filter("block and not coalesce(allow, false)").select("root")
    aliases = written(told.join(blocked, "root").select("key").distinct(), "url-blocked").select("key", F.lit(0).cast("bigint").alias("salt"), F.lit("block").alias("alias"))
    # pages without a host have no alias; a salt keeps them from meeting in one task
    salt = F.when(F.col("key").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("salt", salt).join(aliases, ["key", "salt"], "left").select("row", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), parts AS (
  SELECT page_id, url, html,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM p
), found AS (
  SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
      lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
      lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS t
  FROM parts
), target AS (
  SELECT url AS a, replace(t, '&amp;', '&') AS t FROM found WHERE t <> ''
), edge AS (
  SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || t
    ELSE regexp_extract(a, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) || t END AS b FROM target
), urls AS (
  SELECT url FROM p UNION SELECT a FROM edge UNION SELECT b FROM edge
), judged AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS key,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls)
), verdicts AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM judged
), linked AS (
  SELECT DISTINCT x.key AS a, y.key AS b FROM edge JOIN judged x ON edge.a = x.url JOIN judged y ON edge.b = y.url WHERE x.key IS NOT NULL AND y.key IS NOT NULL
), both_ways AS (
  SELECT a, b FROM linked UNION SELECT b, a FROM linked
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), alias AS (
  SELECT reach.a AS key, bool_or(own = 'block') AS block, bool_or(own = 'allow') AS allow FROM reach JOIN verdicts ON verdicts.key = reach.b GROUP BY 1
)
SELECT p.page_id, v.host, v.path, v.rule,
  coalesce(v.own, CASE WHEN alias.block AND NOT coalesce(alias.allow, false) THEN 'block' END, 'allow') AS verdict
FROM p JOIN verdicts v ON v.url = p.url LEFT JOIN alias ON alias.key = v.key
"""
