"""URL filters with redirect equivalence; DataFrame functions only.

Host and path rules decide the pages that they fit. Redirects and canonical links join pages to
classes of aliases (distributed connected components), and a blocked page blocks its aliases. A
page that a rule allows stays allowed whatever its aliases are.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What makes two urls the same page: host, path and query; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The number of the longest rule that fits, by host and then by path; the first of equals."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(i))
        for i, r in ((i, rules[i]) for i in order)
    ]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def beside(url: Column, to: Column) -> Column:
    """A path- or query-relative target against the page's url; null for empty ones, fragments and other schemes."""
    site, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.regexp_extract(to, r"^[^?#]*", 0)), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda own, x: F.when(x == "..", F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(1)))).when(x == ".", own).otherwise(F.concat(own, F.array(x))),
    )
    return (
        F.when((to == "") | to.startswith("#") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), F.lit(None).cast("string"))
        .when(to.startswith("?"), F.concat(site, path, to))
        .otherwise(F.concat(site, F.array_join(kept, "/"), rest))
    )


def link_targets(url: Column, html: Column) -> Column:
    """Where a page says it belongs: its canonical links and meta refreshes, made absolute."""
    tag = r"(?is)<(?:link|meta)\b[^>]*>"
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag), F.lit(0))

    def target(t: Column) -> Column:
        canonical = F.when(t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
        refresh = F.when(t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1))
        to = F.coalesce(canonical, refresh)
        site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
        scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
        return (
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(scheme, to))
            .when(to.startswith("/"), F.concat(site, to))
            .otherwise(beside(url, to))
        )

    may = F.coalesce(html, F.lit("")).rlike(r"(?i)canonical|http-equiv")
    return F.when(may, F.array_distinct(F.array_compact(F.transform(tags, target)))).otherwise(F.array().cast("array<string>"))


def url_filter(
    pages: DataFrame,
    rules: Sequence[UrlRule] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_class, inherited.

    ``redirects(source_url, target_url)`` adds links to those found in the html. Two pages of one
    address (host, path and query) are aliases too, and so are pages that point at one address,
    whether or not it is a page here. verdict: the rule's; else block if a page of the class is
    blocked by a rule; else allow. alias_class: the least address of the class. Null urls and urls without ``://`` have empty host and path, fit
    no rule, and have no class; repeated rows are judged alike; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    url = F.col(url_col)
    parsed = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        address_of(url).alias("address"),
        F.array_distinct(F.filter(F.transform(link_targets(url, html), address_of), lambda x: x.isNotNull())).alias("targets"),
    ).withColumn("rule_no", rule_for(F.col("host"), F.col("path"), rules))
    judged = scratch.write(parsed, "pages")
    links = judged.where("address is not null").select(F.col("address").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        more = redirects.select(address_of(F.col("source_url")).alias("a"), address_of(F.col("target_url")).alias("b"))
        links = links.unionByName(more.where("a is not null and b is not null"))
    links = scratch.write(links.distinct(), "links")
    # A number for each address with a link; the written table holds it from here on.
    nodes = links.select(F.col("a").alias("address")).union(links.select("b")).distinct().withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.write(nodes, "nodes")
    number = lambda c: nodes.select(F.col("address").alias(c), F.col("node").alias(f"n_{c}"))
    found = components(scratch, links.join(number("a"), "a").join(number("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")))
    found = nodes.join(found.withColumnRenamed("id", "node"), "node").select("address", "component")
    names_of = found.groupBy("component").agg(F.min("address").alias("alias_class"))
    classes = scratch.write(found.join(names_of, "component"), "classes")
    scratch.keep("pages", "classes")
    verdicts = F.array(*(F.lit(r.verdict) for r in rules))
    names = F.array(*(F.lit(r.name) for r in rules))
    joined = judged.join(classes, "address", "left").withColumn("own", F.get(verdicts, F.col("rule_no")))
    blocked = joined.where("own = 'block' and component is not null").select("component").distinct().withColumn("inherited", F.lit(True))
    return joined.join(blocked, "component", "left").select(
        "page_id",
        "host",
        "path",
        F.get(names, F.col("rule_no")).alias("rule"),
        F.coalesce("own", F.when(F.col("inherited"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("alias_class", "address").alias("alias_class"),
        (F.col("own").isNull() & F.col("inherited").isNotNull()).alias("inherited"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).drop("alias_class")


def _oracle() -> str:
    def host(u: str) -> str:
        return f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"

    def address(u: str) -> str:
        rest = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
        return f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"

    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    href, to = r"""(?i)\bhref\s*=\s*["'']?([^"''\s>]+)""", r"""(?i)url\s*=\s*["'']?([^"''\s>]+)"""
    return rf"""
WITH RECURSIVE r(verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id, url, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {address('url')} AS addr FROM pages),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS own
        FROM p, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
tags AS (SELECT url, addr, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE addr IS NOT NULL),
raw AS (SELECT url, addr, CASE WHEN regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '{href}', 1)
        WHEN regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '{to}', 1) END AS x FROM tags),
rel AS (SELECT *, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') AS own FROM raw),
cut AS (SELECT *, string_split(regexp_replace(own, '[^/]*$', '') || regexp_extract(x, '^[^?#]*', 0), '/') AS s FROM rel),
dots AS (SELECT *, CASE WHEN s[-1] IN ('.', '..') THEN list_append(s, '') ELSE s END AS s2 FROM cut),
whole AS (SELECT addr, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || x WHEN starts_with(x, '/') THEN site || x
          WHEN x = '' OR starts_with(x, '#') OR regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL WHEN starts_with(x, '?') THEN site || own || x
          ELSE site || array_to_string(list_reduce(list_transform(s2, lambda y: [y]), lambda acc, y: CASE WHEN y[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN y[1] = '.' THEN acc ELSE list_concat(acc, y) END), '/')
               || regexp_extract(x, '(?s)^[^?#]*(.*)$', 1) END AS x FROM dots),
link AS (SELECT addr AS a, {address('x')} AS b FROM whole WHERE x IS NOT NULL),
both_ways AS (SELECT a, b FROM link WHERE b IS NOT NULL UNION SELECT b, a FROM link WHERE b IS NOT NULL),
bad(addr) AS (SELECT addr FROM p JOIN fit USING (page_id) WHERE own = 'block' AND addr IS NOT NULL
              UNION SELECT b FROM bad JOIN both_ways ON a = addr)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN bad.addr IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       own IS NULL AND bad.addr IS NOT NULL AS inherited
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN bad ON bad.addr = p.addr
"""


ORACLE = _oracle()
