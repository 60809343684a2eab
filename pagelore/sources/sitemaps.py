"""Sitemap XML and robots.txt as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..operators.skew import spread_join

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("loc", "lastmod", "changefreq", "priority")])


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """<url> entries of sitemap files in any namespace; the reader splits large files."""
    d = (spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True)
         .schema(ENTRY).load(path))
    return d.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"),
                    F.lower(F.trim("changefreq")).alias("changefreq"),
                    F.expr("try_cast(priority AS double)").alias("priority")).where("loc IS NOT NULL AND loc <> ''")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    d = (spark.read.format("xml").option("rowTag", "sitemap").option("ignoreNamespace", True)
         .schema(T.StructType([T.StructField("loc", T.StringType())])).load(path))
    return d.select(F.trim("loc").alias("loc")).where("loc IS NOT NULL")


ENTRY_DDL = "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
INDEX_DDL = "sitemap array<struct<loc:string>>"
_XML = {"ignoreNamespace": "true"}


def parse_sitemaps(docs: DataFrame, body: str) -> DataFrame:
    """Entries of stored sitemap documents (one document per row); other columns are kept."""
    keep = [c for c in docs.columns if c != body]
    d = docs.select(*keep, F.explode(F.from_xml(F.col(body), ENTRY_DDL, _XML)["url"]).alias("u"))
    return d.select(*keep, F.trim("u.loc").alias("loc"), F.trim("u.lastmod").alias("lastmod"),
                    F.lower(F.trim("u.changefreq")).alias("changefreq"),
                    F.expr("try_cast(u.priority AS double)").alias("priority")).where("loc <> ''")


def expand_index(indexes: DataFrame, body: str, children: DataFrame, child_url: str) -> DataFrame:
    """Child sitemap rows named by index documents; one level per call."""
    locs = indexes.select(F.explode(F.from_xml(F.col(body), INDEX_DDL, _XML)["sitemap"]).alias("s")).select(
        F.trim("s.loc").alias(child_url)).where(f"{child_url} <> ''").distinct()
    return children.join(locs, child_url)


def robots_lines(robots: DataFrame) -> DataFrame:
    """(host, line_no, field, value) of robots files given as (host, body); comments dropped."""
    line = F.regexp_replace(F.col("line"), r"\s*#.*$", "")
    return (robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
            .select("host", "line_no", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("field"),
                    F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
            .where("field <> ''"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    return robots_lines(robots).where("field = 'sitemap'").select("host", F.col("value").alias("sitemap_url"))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """One row per host: array of (prefix length, allow, prefix) for the agent's group.

    Works on the split body of each file, so no shuffle: a fold carries whether the current group holds the agent,
    and whether the group is still open to further agent lines, which it is until its first rule. Agents are compared
    without case.
    """
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.regexp_replace(x, r"\s*#.*$", ""))
    field = lambda x: F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    rule_t = "array<struct<len:int,allow:boolean,prefix:string>>"
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("open"), F.array().cast(rule_t).alias("rules"))

    def step(acc, x):
        is_agent = field(x) == "user-agent"
        is_rule = field(x).isin("allow", "disallow") & (value(x) != "") & acc["on"]
        mine = F.lower(value(x)) == agent.lower()
        rule = F.struct(F.length(value(x)).alias("len"), (field(x) == "allow").alias("allow"),
                        value(x).alias("prefix"))
        return F.struct(
            F.when(is_agent, mine | (acc["on"] & acc["open"])).otherwise(acc["on"]).alias("on"),
            (is_agent | (acc["open"] & ~field(x).isin("allow", "disallow", "crawl-delay", "request-rate"))).alias("open"),
            F.when(is_rule, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]).alias("rules"))

    return robots.select("host", F.aggregate(lines, start, step)["rules"].alias("rules"))


def allowed_by_robots(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds `allowed`: the longest prefix of path and query decides, no rule or no file means allowed."""
    left = pages.withColumn("host", U.host(F.col(url)))
    joined = spread_join(left, rules, ["host"], "left", salt_by=[url])
    hit = F.array_max(F.filter(F.coalesce(F.col("rules"), F.array().cast(
        "array<struct<len:int,allow:boolean,prefix:string>>")),
        lambda r: F.startswith(U.path_and_query(F.col(url)), r["prefix"])))
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("rules", "host")


def urlset_xml(loc: Column, lastmod: Column, changefreq: Column, priority: Column) -> Column:
    """One sitemap document with one entry (test data and export)."""
    return F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'),
                    F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), lastmod,
                    F.lit("</lastmod><changefreq>"), changefreq, F.lit("</changefreq><priority>"),
                    priority, F.lit("</priority></url></urlset>"))
