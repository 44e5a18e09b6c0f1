"""URL filters with redirect equivalence, by DataFrame operations only.

Rules name a host and a path; a rule fits the host and its subdomains where the path of the
url starts with the rule's, and the longest rule that fits decides. Pages without a rule
take the decision of their aliases: urls that are equal after normalization, or connected
by canonical links and redirects (``<link rel=canonical>``, ``<meta http-equiv=refresh>``
and, if given, a table of redirects). An explicit allow anywhere in a component goes before
a block; without either the page is allowed.

Rules are matched to distinct hosts, not to pages. Only urls that have an edge enter the
connected components; a hot host or target is one aggregated row there.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no
rule; null and empty html has no links; a link that is neither absolute nor begins with a
slash is ignored; repeated rows are judged alike and all returned.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.llm.common import slim, stored
from auditweave.llm.components import connected

#: (action, rule): the host, then the path from its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Host, path and query without scheme, default port, fragment, utm parameters and end slash."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    joined = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(joined, F.lit("?"), F.array_join(kept, "&"))).otherwise(joined)


def links_of(url: Column, html: Column) -> Column:
    """Absolute urls of the canonical links and refresh targets of a page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAG), F.lit(0))

    def target(tag: Column) -> Column:
        return F.when(tag.rlike(_CANONICAL), F.regexp_extract(tag, _HREF, 1)).when(
            tag.rlike(_REFRESH), F.regexp_extract(tag, _TARGET, 1)
        )

    def absolute(link: Column) -> Column:
        return (
            F.when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when(link.startswith("/"), F.concat(F.lit("http://"), host_of(url), link))
            .when(link.contains("://"), link)
        )

    return F.filter(F.transform(tags, lambda t: absolute(target(t))), lambda u: u.isNotNull())


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of it and its parent domains, longest first."""
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    keyed = rules.select(
        F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"),
        F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"), "rule", "action",
    )
    entry = F.struct((-F.length("rule")).alias("order"), "action", "rule", "start")
    return (
        hosts.where("host != ''").select("host", F.explode(parents).alias("suffix")).join(keyed, "suffix")
        .groupBy("host").agg(F.array_sort(F.collect_set(entry)).alias("rules"))
    )


def _decided(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest rule that fits (host, path), or nulls."""
    fitting = _fitting(rows.select("host").distinct(), rules)
    first = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(1))
    return rows.join(fitting, "host", "left").withColumn("__first", first).select(
        *rows.columns, F.col("__first.rule").alias("rule"), F.col("__first.action").alias("action")
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has (action, rule); ``redirects`` may have (source, target) urls.
    """
    source = slim(pages, page_id=page_id, url=url, html=html)
    parsed = stored(
        source.select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            F.when(host_of(F.col("url")) != "", normal_form(F.col("url"))).alias("node"),
            links_of(F.col("url"), F.col("html")).alias("links"),
        ),
        "parsed",
    )
    targets = parsed.where(F.col("node").isNotNull()).select("node", F.explode("links").alias("target"))
    if redirects is not None:
        targets = targets.union(redirects.select(normal_form(F.col("source")), "target"))
    edges = stored(
        targets.select(
            "node", normal_form(F.col("target")).alias("other"),
            host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"),
        ).where("node != other").distinct(),
        "edges",
    )
    labels = connected(edges, "node", "other")

    decided = stored(_decided(parsed.drop("links"), rules), "decided")
    outside = _decided(edges.select(F.col("other").alias("node"), "host", "path").distinct(), rules)
    explicit = (
        decided.select("node", "action").union(outside.select("node", "action"))
        .where("action is not null and node is not null").distinct()
    )
    facts = (
        explicit.join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("group"))
        .agg(F.bool_or(F.col("action") == "allow").alias("allowed"))
    )
    open_pages = decided.where("action is null").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    inherited = open_pages.join(facts, "group", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("allowed") == False, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),  # noqa: E712
    )
    ruled = decided.where("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"))
    return ruled.unionByName(inherited)


def default_rules(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(RULES), "action string, rule string")


#: The same judgement in DuckDB over ``pages``; components by recursion over the edges.
ORACLE = r"""
WITH RECURSIVE rules(action, rule) AS (VALUES ('block','net/'), ('allow','example.net/en/'), ('block','example.com/de/'), ('allow','org/fr/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
raw AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS link FROM tags),
linked AS (
  SELECT url AS source, CASE WHEN link LIKE '//%' THEN 'http:' || link
    WHEN link LIKE '/%' THEN 'http://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || link
    WHEN link LIKE '%://%' THEN link END AS target FROM raw),
urls AS (SELECT url FROM pages UNION SELECT target FROM linked),
parts AS (
  SELECT url, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    [p FOR p IN string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&') IF p <> '' AND NOT starts_with(p, 'utm_')] AS kept
  FROM urls WHERE url IS NOT NULL),
nodes AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS node FROM parts),
ranked AS (
  SELECT n.url, r.rule, r.action, row_number() OVER (PARTITION BY n.url ORDER BY length(r.rule) DESC, r.action, r.rule) AS k
  FROM nodes n JOIN rules r ON (n.host = split_part(r.rule, '/', 1) OR ends_with(n.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(n.path, substr(r.rule, instr(r.rule, '/')))),
decided AS (SELECT n.*, k.rule, k.action FROM nodes n LEFT JOIN ranked k ON k.url = n.url AND k.k = 1),
edges AS (
  SELECT a.node AS u, b.node AS v FROM linked l JOIN nodes a ON a.url = l.source JOIN nodes b ON b.url = l.target WHERE a.node <> b.node),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached(node, label) AS (
  SELECT DISTINCT u, u FROM both_ways UNION SELECT e.v, r.label FROM reached r JOIN both_ways e ON e.u = r.node),
labels AS (SELECT node, min(label) AS label FROM reached GROUP BY node),
grouped AS (SELECT d.*, coalesce(l.label, d.node) AS grp FROM decided d LEFT JOIN labels l USING (node)),
facts AS (SELECT grp, bool_or(action = 'allow') AS allowed FROM grouped WHERE action IS NOT NULL GROUP BY grp)
SELECT p.page_id, coalesce(g.host, '') AS host, coalesce(g.path, '') AS path, g.rule,
  coalesce(g.action, CASE WHEN f.allowed = false THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN grouped g ON g.url = p.url LEFT JOIN facts f ON f.grp = g.grp
"""
