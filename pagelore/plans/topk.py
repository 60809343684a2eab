"""Sorts, limits and top-k over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import sets as Z
from ..operators.skew import top_per_key
from .derived import LINES
from .registry import Inputs, query


@query("top_01_global", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def global_top(t: Inputs):
    return t.lineitem.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("top_02_per_key", """
SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def per_key(t: Inputs):
    return top_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("top_03_multi_key", """
SELECT url, source, priority FROM (SELECT url, ['sitemap','index','search','crawl','other'][(page_id % 5 + 1)::INT] AS source, CASE WHEN page_id % 3 > 0 THEN page_id % 3 END AS priority FROM pages)
ORDER BY CASE source WHEN 'sitemap' THEN 1 WHEN 'index' THEN 2 WHEN 'search' THEN 3 WHEN 'crawl' THEN 4 ELSE 5 END, priority DESC NULLS LAST, url LIMIT 30""")
def multi_key(t: Inputs):
    d = t.pages.select("url", F.element_at(F.array(*[F.lit(x) for x in (*Z.SOURCE_RANK, "other")]), (F.col("page_id") % 5 + 1).cast("int")).alias("source"),
                       F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 3).alias("priority"))
    return d.orderBy(*Z.frontier_order(d)).limit(30)


@query("top_04_threshold_order", """
SELECT url, round(length(html) / 5000.0, 6) AS score FROM pages WHERE length(html) / 5000.0 >= 0.5 ORDER BY score DESC, url""")
def threshold_order(t: Inputs):
    d = t.pages.select("url", F.round(F.length("html") / 5000.0, 6).alias("score"), (F.length("html") / 5000.0).alias("raw"))
    return d.where("raw >= 0.5").drop("raw").orderBy(F.col("score").desc(), "url")


@query("top_05_frontier_cap", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn <= 100""")
def frontier_cap(t: Inputs):
    """The hundred best pending entries of each crawl."""
    p = t.events.where("event_type <> 'error'").select("user_id", "event_id", "value")
    return top_per_key(p, ["user_id"], [F.col("value").desc(), F.col("event_id")], 100).select("user_id", "event_id")


@query("top_06_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80")
def offset(t: Inputs):
    return t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(80).limit(40).select("o_orderkey")


@query("top_07_document_order", f"""
WITH l AS ({LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, i) AS rn FROM l)
SELECT doc_id, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) AS positions FROM r WHERE rn <= 4 GROUP BY 1""")
def document_order(t: Inputs):
    """Longest four lines of each document, listed by position: choice and order both inside the row."""
    scored = F.transform(F.split("text", "\n"), lambda s, i: F.struct((-F.length(F.trim(s))).alias("o"), i.alias("i")))
    best = F.slice(F.array_sort(scored), 1, 4)
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.transform(best, lambda x: x["i"])), ",").alias("positions"))


@query("top_08_token_budget", f"""
WITH l AS ({LINES}), r AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY length(line) DESC, i) AS run FROM l)
SELECT doc_id, (i - 1)::INT AS i FROM r WHERE run <= 4 * 150""")
def token_budget(t: Inputs):
    """Lines by length until 150 tokens (600 characters) are used up."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return Z.budget_prefix(l, ["doc_id"], [F.length(F.trim("line")).desc(), F.col("i")], F.length(F.trim("line")), 600).select("doc_id", "i")


@query("top_09_overfetch", """
SELECT page_id, url FROM pages WHERE NOT contains(url, 'page=2') ORDER BY length(html) DESC, page_id LIMIT 20""")
def overfetch(t: Inputs):
    """Filtered first and then cut: taking twice the wanted number and filtering after can give fewer than wanted."""
    d = t.pages.select("page_id", "url", F.length("html").alias("n"))
    return d.where(~F.contains("url", F.lit("page=2"))).orderBy(F.col("n").desc(), "page_id").limit(20).select("page_id", "url")
