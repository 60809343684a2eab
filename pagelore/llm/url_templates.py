"""URL filter: host rules, and per host a tree of path templates judged by smoothed labelled purity.

* Rules (kind, host, path) hold for a host and its subdomains where the path starts with the rule's; the longest rule
  wins (most host labels first, then the longer path). They are a fixed list of literals in the plan.
* Tree: level by level, every URL carries the template of the segments so far. Per template, the next segments are
  counted. A segment stays as it is if it stands for at least `least_share` of its template's URLs and `least_urls`
  of them; otherwise it is variable and becomes a wildcard of its shape (digits, digits with extension, word).
* Merging: branches that stay below the same template are ordered by their smoothed rate of bad labels, and neighbours
  in that order that no Hoeffding bound tells apart become one branch, named by its least segment and its number. No two
  branches are paired but neighbours.
* Purity: a template is rejected if its share of bad labels, smoothed with `prior_weight` labels of its parents' rate up
  to the whole table's, reaches `reject`. Templates without labels get the rate above them.

All is aggregates by (host, template), combined before the shuffle; a host that owns a third of the URLs is no more
than its templates after that, and rows meet their template's figures over salted copies. A level holds only the URLs that
have a further segment below a template of `least_urls` or more: below a smaller one all segments are variable, so
what is left of such URLs, however deep, is named and counted in one pass for all levels.

Cases: null or schemeless addresses have an empty host and path (no rule but one with an empty host could hold, and
there is none) and a template of their own; a URL counts once however often it occurs; ties between rules go to the
longer path and cannot remain, as rules differ in host or path; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..session import Scratch, write_and_read

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; null or none: empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (r[1].count("."), len(r[1]), len(r[2]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _shape(segment: Column) -> Column:
    return (F.when(segment.rlike(r"^[0-9]+$"), "{n}").when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
            .when(segment.rlike("[0-9]"), "{id}").when(segment == "", "").otherwise("{w}"))


def templates(urls: DataFrame, least_share: float = 0.01, least_urls: int = 20, confidence: float = 0.05, prior_weight: float = 2.0) -> DataFrame:
    """(key, host, template, n_urls, n_labels, n_bad, purity) per URL key, from (key, host, path, label); label 1 is bad.

    purity is the smoothed share of bad labels of the URL's template.
    """
    segments = F.filter(F.split(F.regexp_replace("path", "^/", ""), "/"), lambda x: x.isNotNull())
    scratch = Scratch(urls.sparkSession)
    rows = scratch.write(urls.select("key", "host", segments.alias("s"), "label", F.lit("").alias("template")), "urls")
    whole = rows.agg(F.count("label"), F.sum("label")).first()
    above = F.lit((whole[1] or 0) / whole[0] if whole[0] else 0.0)
    counts = [F.count(F.lit(1)).alias("n_urls"), F.count("label").alias("n_labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_bad")]

    def smoothed(bad: Column, labels: Column, over: Column) -> Column:
        return (bad + prior_weight * over) / (labels + prior_weight)

    figures = ["n_urls", "n_labels", "n_bad", "purity"]
    done, tails, level = [], [], 0
    rates = rows.groupBy("host", "template").agg(*counts).withColumn("purity", smoothed(F.col("n_bad"), F.col("n_labels"), above))
    while True:
        now = scratch.write(spread_join(rows, rates, ["host", "template"], salt_by=["key"]), "level")
        further = F.size("s") > level
        done.append(now.where(~further).select("key", "host", "template", *figures))
        tails.append(now.where(further & (F.col("n_urls") < least_urls)).select("key", "host", "label", "template", F.slice("s", level + 1, 1 << 30).alias("s"), "purity"))
        at = now.where(further & (F.col("n_urls") >= least_urls)).withColumn("segment", F.get("s", F.lit(level)))
        if at.isEmpty():
            break
        child = at.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"),
                                                              F.any_value("n_urls").alias("total"), F.any_value("purity").alias("above"))
        stays = (F.col("n") >= least_urls) & (F.col("n") >= least_share * F.col("total"))
        named = child.where(stays).withColumn("rate", smoothed(F.col("bad"), F.col("labels"), F.col("above")))
        # at most 1 / least_share branches stay below a template
        w = Window.partitionBy("host", "template").orderBy("rate", "segment")
        gap = F.col("rate") - F.lag("rate").over(w)
        bound = math.sqrt(0.5 * math.log(2 / confidence)) * (1 / F.sqrt(F.greatest(F.col("labels"), F.lit(1))) + 1 / F.sqrt(F.greatest(F.lag("labels").over(w), F.lit(1))))
        merged = named.withColumn("apart", F.coalesce((gap > bound).cast("int"), F.lit(1))).withColumn("group", F.sum("apart").over(w))
        g = Window.partitionBy("host", "template", "group")
        merged = merged.select("host", "template", "segment", F.when(F.count(F.lit(1)).over(g) > 1, F.concat(
            F.lit("{"), F.min("segment").over(g), F.lit("+"), (F.count(F.lit(1)).over(g) - 1).cast("string"), F.lit("}"))).otherwise(F.col("segment")).alias("branch"))
        merged = scratch.write(merged, "branches")
        step = spread_join(at, merged, ["host", "template", "segment"], "left", salt_by=["key"])
        nxt = F.concat("template", F.lit("/"), F.coalesce("branch", _shape(F.col("segment"))))
        rows = scratch.write(step.select("key", "host", "s", "label", nxt.alias("template"), F.col("purity").alias("above")), "urls")
        rates = rows.groupBy("host", "template").agg(*counts, F.any_value("above").alias("above"))
        rates = rates.select("host", "template", "n_urls", "n_labels", "n_bad", smoothed(F.col("n_bad"), F.col("n_labels"), F.col("above")).alias("purity"))
        rows = rows.drop("above")
        level += 1
    rest = _union(tails).withColumn("s", F.transform("s", _shape))
    place = F.posexplode(F.transform("s", lambda _, i: F.concat("template", F.lit("/"), F.array_join(F.slice("s", 1, i + 1), "/"))))
    below = rest.select("host", "label", "purity", F.concat("template", F.lit("/"), F.array_join("s", "/")).alias("whole"), place.alias("i", "template"))
    part = below.groupBy("host", "template").agg(*counts)
    path = below.groupBy("host", "whole", "i", "template").agg(F.any_value("purity").alias("above"))
    path = path.join(part, ["host", "template"]).groupBy("host", "whole").agg(  # as many as the template has segments
        F.any_value("above").alias("above"), F.array_sort(F.collect_list(F.struct("i", "n_urls", "n_labels", "n_bad"))).alias("p"))
    last = F.element_at("p", -1)
    path = path.select("host", F.col("whole").alias("template"), *[last[c].alias(c) for c in figures[:-1]],
                       F.aggregate("p", F.col("above"), lambda a, x: smoothed(x["n_bad"], x["n_labels"], a)).alias("purity"))
    tail_rows = rest.select("key", "host", F.concat("template", F.lit("/"), F.array_join("s", "/")).alias("template"))
    out = _union([*done, spread_join(tail_rows, path, ["host", "template"], salt_by=["key"]).select("key", "host", "template", *figures)])
    out = write_and_read(out, "templates")
    scratch.clear()
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = 0.6, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page; `labels` are (url, label) with label 1 for bad."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    known = labels.where("url is not null and label is not null").groupBy("url").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    keyed = rows.select("url", "host", "path").distinct().join(known, "url", "left")
    tree = templates(keyed.select(F.col("url").alias("key"), "host", "path", "label"), **options)
    j = rows.join(tree.select(F.col("key").alias("url"), "template", "purity"), "url")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return j.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def _level_sql(k: int) -> str:
    bound = "sqrt(0.5 * ln(2 / 0.05))"
    return rf"""
a{k} AS (SELECT *, s[{k + 1}] AS segment, count(*) OVER (PARTITION BY host, template) AS total FROM r{k}),
c{k} AS (SELECT host, template, segment, count(*) AS n, count(label) AS labels, (coalesce(sum(label), 0) + 2 * any_value(purity)) / (count(label) + 2) AS rate
  FROM a{k} WHERE segment IS NOT NULL GROUP BY host, template, segment HAVING count(*) >= 20 AND count(*) >= 0.01 * any_value(total)),
d{k} AS (SELECT *, rate - lag(rate) OVER w > {bound} * (1 / sqrt(greatest(labels, 1)) + 1 / sqrt(greatest(lag(labels) OVER w, 1))) AS apart
  FROM c{k} WINDOW w AS (PARTITION BY host, template ORDER BY rate, segment)),
g{k} AS (SELECT *, sum(CASE WHEN apart IS NULL OR apart THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY rate, segment) AS part FROM d{k}),
b{k} AS (SELECT host, template, segment, CASE WHEN count(*) OVER p > 1 THEN '{{' || min(segment) OVER p || '+' || (count(*) OVER p - 1) || '}}' ELSE segment END AS branch
  FROM g{k} WINDOW p AS (PARTITION BY host, template, part)),
n{k} AS (SELECT a.*, CASE WHEN a.segment IS NULL THEN a.template ELSE a.template || '/' || coalesce(branch, CASE WHEN regexp_matches(a.segment, '^[0-9]+$') THEN '{{n}}'
  WHEN regexp_matches(a.segment, '^[0-9]+\.[A-Za-z0-9]+$') THEN '{{n}}.' || regexp_extract(a.segment, '\.([A-Za-z0-9]+)$', 1) WHEN regexp_matches(a.segment, '[0-9]') THEN '{{id}}' WHEN a.segment = '' THEN '' ELSE '{{w}}' END) END AS nxt
  FROM a{k} a LEFT JOIN b{k} b ON a.host = b.host AND a.template = b.template AND a.segment = b.segment),
r{k + 1} AS (SELECT url, host, s, label, nxt AS template, CASE WHEN segment IS NULL THEN purity
  ELSE (coalesce(sum(label) OVER q, 0) + 2 * purity) / (count(label) OVER q + 2) END AS purity FROM n{k} WINDOW q AS (PARTITION BY host, nxt))"""


def sql(levels: int = 6) -> str:
    """The verdicts with `RULES`, the levels written one after another: right for paths of at most `levels` segments."""
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}|{v}'"
                     for v, h, p in sorted(RULES, key=lambda r: (-r[1].count("."), -len(r[1]), -len(r[2]))))
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
y AS (SELECT url, (avg(1 - quality) > 0.5)::INTEGER AS label FROM (SELECT url, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[A-Za-z]+|/)?$', 1) AS BIGINT) AS doc_id FROM p) JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY url),
u AS (SELECT url, host, string_split(regexp_replace(path, '^/', ''), '/') AS s, label FROM (SELECT DISTINCT url, host, path FROM p) LEFT JOIN y USING (url)),
z AS (SELECT coalesce(sum(label) / count(label), 0) AS base FROM u),
r0 AS (SELECT url, host, s, label, '' AS template, (coalesce(sum(label) OVER h, 0) + 2 * base) / (count(label) OVER h + 2) AS purity FROM u, z WINDOW h AS (PARTITION BY host)),
{",".join(_level_sql(k) for k in range(levels))},
v AS (SELECT p.page_id, p.host, p.path, CASE {rules} END AS hit FROM p)
SELECT v.page_id, v.host, v.path, split_part(hit, '|', 1) AS rule, coalesce(split_part(hit, '|', 2), CASE WHEN purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict, template, CAST(round(purity, 9) AS DOUBLE) AS purity
FROM v JOIN p USING (page_id) JOIN r{levels} r ON p.url = r.url"""
