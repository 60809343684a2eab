"""Link graph, crawl and knowledge graph queries over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dom
from ..functions import scoring as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import adaptive as A
from ..operators import entities as E
from ..operators import graph as G
from ..operators import joins as J
from ..operators import pages as P
from ..operators import vectors as V
from ..operators.skew import numbered
from . import derived
from .aggregates import LINK_SQL, page_links
from .derived import EDGE_SQL, ENTITY_SQL
from .html import MAIN_SQL
from .registry import Inputs, query
from .windows import SCORES_SQL, scored_links

HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
PATH = "lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1))"


@query("gra_01_link_scores", f"WITH {SCORES_SQL} SELECT page_id, link, pos::INT AS pos, round(relevance, 6)::DOUBLE AS relevance, round(authority, 6)::DOUBLE AS authority, round(quality, 6)::DOUBLE AS quality, round(freshness, 6)::DOUBLE AS freshness, round(overall, 6)::DOUBLE AS overall FROM scored WHERE round(overall, 6) >= 0.3")
def link_scores(t: Inputs):
    return scored_links(t).where("overall >= 0.3").select("page_id", "link", "pos", "relevance", "authority", "quality", "freshness", "overall")


@query("gra_02_url_scorers", f"""
WITH u AS (SELECT page_id, url || '/20' || (10 + page_id % 15) || '/x' AS url FROM pages),
s AS (SELECT page_id, ((contains(lower(url), 'blog'))::INT + (contains(lower(url), 'en'))::INT) / 2 AS k, greatest(0, 1 - len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) / 5) AS d,
  0.5 AS dom, greatest(0, 1 - (2024 - (2010 + page_id % 15)) / 10) AS y FROM u)
SELECT page_id, round(k, 6)::DOUBLE AS keyword, round(d, 6)::DOUBLE AS depth, round(y, 6)::DOUBLE AS freshness, round((k * 2 + d + dom + y) / 5, 6)::DOUBLE AS composite FROM s""")
def url_scorers(t: Inputs):
    u = F.concat("url", F.lit("/20"), 10 + F.col("page_id") % 15, F.lit("/x"))
    k, d, dom, y = S.keyword_score(u, ["Blog", "en"]), S.depth_score(u), S.domain_score(u), S.year_score(u, 2024)
    return t.pages.select("page_id", F.round(k, 6).alias("keyword"), F.round(d, 6).alias("depth"), F.round(y, 6).alias("freshness"), F.round(S.composite([(k, 2), (d, 1), (dom, 1), (y, 1)]), 6).alias("composite"))


@query("gra_03_seed_scores", f"""
WITH u AS (SELECT page_id, url, ['sitemap','cc','crawl'][(page_id % 3 + 1)::INT] AS source, {PATH} AS p, len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS d FROM pages)
SELECT page_id, round(least(1.0, CASE source WHEN 'sitemap' THEN 0.8 WHEN 'cc' THEN 0.6 ELSE 0.5 END + CASE WHEN source = 'sitemap' THEN 0.5 * 0.2 + 0.06 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'blog|article|post|news|guide|tutorial|documentation|docs|help|support|about') THEN 0.1 ELSE 0 END + CASE WHEN d <= 2 THEN 0.1 WHEN d > 4 THEN -0.1 ELSE 0 END
  + CASE WHEN regexp_matches(p, '\\.(html|htm|php)$') THEN 0.05 ELSE 0 END + len(list_intersect(['feed','example'], list_distinct(regexp_extract_all(lower(url), '[a-z]+')))) / 2 * 0.3 + CASE WHEN source = 'crawl' THEN 0.05 ELSE 0 END), 6)::DOUBLE AS score FROM u""")
def seed_scores(t: Inputs):
    src = F.element_at(F.array(F.lit("sitemap"), F.lit("cc"), F.lit("crawl")), (F.col("page_id") % 3 + 1).cast("int"))
    d = t.pages.select("page_id", "url", src.alias("source"))
    s = S.seed_score(F.col("url"), F.col("source"), F.lit(0.5), F.lit("Weekly"), F.lit(301), X.literal_set(["feed", "example"]))
    return d.select("page_id", F.round(s, 6).alias("score"))


def seeds(t: Inputs):
    return t.supplier.where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))


@query("gra_04_breadth_first", f"""
WITH RECURSIVE e AS ({EDGE_SQL}), b AS (SELECT 's' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_nationkey = 3 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 3 AND NOT dst LIKE '%7')
SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1""")
def breadth_first(t: Inputs):
    """Crawl of the supplier-part graph from the suppliers of one nation; nodes ending in 7 are filtered out."""
    return G.breadth_first(derived.edges(t), seeds(t), 3, ~F.col("node").endswith("7"))


@query("gra_04_components", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({EDGE_SQL}) UNION SELECT dst, src FROM ({EDGE_SQL})), r AS (SELECT DISTINCT src AS node, src AS c FROM e UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.node)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def components(t: Inputs):
    return G.components(derived.edges(t))


def scored_edges(t: Inputs):
    li = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag", "l_discount")
    a = li.where("l_returnflag <> 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_discount") * 5 + 0.4).alias("score"))
    b = li.where("l_returnflag = 'R'").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), (F.col("l_discount") * 5 + 0.4).alias("score"))
    return a.unionByName(b).groupBy("src", "dst").agg(F.round(F.max("score"), 6).alias("score"))


@query("gra_05_best_first")
def best_first(t: Inputs):
    """One crawl per nation over the supplier-part graph, ten best nodes a round, 40 pages a crawl (order checked in the tests)."""
    s = t.supplier.select(F.col("s_nationkey").cast("string").alias("crawl"), F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.best_first(scored_edges(t), s, batch=10, max_pages=40)


@query("gra_06_depth_first")
def depth_first(t: Inputs):
    from pyspark.sql import Window
    # children of a hub are numbered in slices by the front of their name
    e = numbered(derived.edges(t), ["src"], F.substring("dst", 1, 3), [F.col("dst")], "ord")
    s = seeds(t).withColumn("ord", F.row_number().over(Window.orderBy("node")))  # a few seeds, numbered
    return G.depth_first(e, s, 3).select("node", F.array_join("path", ".").alias("path"))


@query("gra_07_adaptive_crawl")
def adaptive_crawl(t: Inputs):
    """One adaptive crawl per host over the page links: best address first, ended by saturation, confidence, quality or 20 pages."""
    q = X.clean_tokens(X.words(F.lit("thanedble attion guide")))
    links = page_links(t)
    e = links.select(F.col("url").alias("src"), F.col("link").alias("dst"), F.round(S.crawl_score(F.col("link"), q), 6).alias("score"))
    p = dom.parsed_pages(t).select(F.col("url").alias("node"), F.array_distinct(X.text_tokens(F.lower("body_text"))).alias("terms"),
                                   (F.least(F.length("body_text"), F.lit(5000)) / 5000).alias("quality"))
    s = t.pages.select(U.host(F.col("url")).alias("crawl"), F.col("url").alias("node"), q.alias("query"))
    return A.adaptive_crawl(p, e, s, batch=5)


@query("gra_08_website_map", f"""
WITH n AS (SELECT page_id, url, lower(replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', ''), '://www.', '://')) AS norm_url, CASE WHEN page_id % 2 = 0 THEN 'sitemap' ELSE 'crawl' END AS source, (page_id % 10) / 10 AS priority FROM pages WHERE {HOST} LIKE '%.example.org')
SELECT norm_url, arg_min(url, CASE source WHEN 'sitemap' THEN 0 ELSE 10 END - priority) AS url, arg_min(source, CASE source WHEN 'sitemap' THEN 0 ELSE 10 END - priority) AS source FROM n GROUP BY 1""")
def website_map(t: Inputs):
    a = t.pages.where("page_id % 2 = 0").select("url", F.lit("sitemap").alias("source"), ((F.col("page_id") % 10) / 10).alias("priority"), F.lit(None).cast("string").alias("title"))
    b = t.pages.where("page_id % 2 = 1").select("url", F.lit("crawl").alias("source"), ((F.col("page_id") % 10) / 10).alias("priority"), F.concat(F.lit("t"), "page_id").alias("title"))
    return G.website_map([a, b], "https://example.org/").select("norm_url", "url", "source")


@query("gra_09_knowledge_nodes", f"""
WITH m AS (SELECT DISTINCT value, entity_type, source_url FROM ({ENTITY_SQL})) SELECT substr(md5(entity_type || ':' || value), 1, 12) AS id, value AS name, entity_type, count(*) AS source_count FROM m GROUP BY value, entity_type""")
def knowledge_nodes(t: Inputs):
    m = derived.entities(t).withColumnsRenamed({"value": "name", "source_url": "source"})
    return G.knowledge_nodes(m).select("id", "name", "entity_type", "source_count")


@query("gra_09_knowledge_edges", f"SELECT value AS src, source_url AS dst, count(*) AS weight FROM ({ENTITY_SQL}) GROUP BY 1, 2")
def knowledge_edges(t: Inputs):
    return G.knowledge_edges(derived.entities(t).withColumnsRenamed({"value": "name", "source_url": "source"}))


@query("gra_10_entity_search", f"""
WITH n AS (SELECT DISTINCT value AS name, source_url FROM ({ENTITY_SQL}) WHERE contains(lower(value), 'er') AND entity_type = 'email') SELECT name, count(*) AS n_relations FROM n GROUP BY 1""")
def entity_search(t: Inputs):
    """Entities by name with their relations attached."""
    m = derived.entities(t).withColumnsRenamed({"value": "name", "source_url": "source"})
    found = G.search_entities(G.knowledge_nodes(m).withColumn("description", F.lit(None).cast("string")), "ER", "email").select("name")
    return G.knowledge_edges(m.where("entity_type = 'email'")).join(found, F.col("src") == F.col("name"), "left_semi").groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n_relations"))


@query("gra_11_multi_entity", r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS v FROM documents), g AS (SELECT lower(v) AS v, doc_id, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT v, sum(n) AS t, sum(n * n) AS sq FROM g GROUP BY 1)
SELECT 'email' AS entity_type, (SELECT count(*) FROM e) AS valid, 0::BIGINT AS invalid, (sum(t * t - sq) / 2)::BIGINT AS matches FROM p""")
def multi_entity(t: Inputs):
    """Documents to typed entities, their validation and cross-reference matches."""
    e = E.find_entities(t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("u"), "text"), "text", "u").where("entity_type = 'email'")
    v = E.validate(e, F.lit(0))
    return v.join(J.cross_reference_matches(e.select("entity_type", "value", "source_url")), "entity_type").select("entity_type", "valid", "invalid", "matches")


@query("gra_12_fetch_list", f"""
SELECT page_id, slot::INT AS slot, round((slot - 1) / 0.5, 6)::DOUBLE AS slot_seconds FROM (SELECT page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY length(html) DESC, page_id) AS slot FROM pages) WHERE slot <= 5""")
def fetch_list(t: Inputs):
    return G.fetch_list(t.pages.select("page_id", "url", F.length("html").alias("n")), U.host(F.col("url")), F.col("n"), "page_id", 0.5, 5).select("page_id", "slot", F.round("slot_seconds", 6).alias("slot_seconds"))


@query("gra_13_enriched_links", """
WITH l AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '/none' ELSE url END AS link FROM pages), p AS (SELECT url, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages WHERE page_id % 3 <> 0)
SELECT l.page_id, link, round(CASE WHEN p.url IS NULL THEN 0 ELSE ((contains(title || ' ' || link, 'the'))::INT + (contains(title || ' ' || link, 'feed'))::INT) / 2 END, 6)::DOUBLE AS score FROM l LEFT JOIN p ON link = url""")
def enriched_links(t: Inputs):
    links = t.pages.select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/none"))).otherwise(F.col("url")).alias("link"))
    p = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.col("page_id") % 3 != 0).alias("ok"))
    return G.enriched_links(links, p, "of The feed").select("page_id", "link", F.round("score", 6).alias("score"))


@query("htm_23_block_clusters")
def block_clusters(t: Inputs):
    """Similar blocks of a page joined into clusters (hashed term vectors, cosine, components); three largest
    clusters of ten words or more per page. Differs from agglomerative linkage; see the tests."""
    from ..operators.clusters import page_clusters
    from ..functions import dom
    return page_clusters(P.blocks(dom.parsed_pages(t)).where("tag IN ('p', 'li', 'h1', 'div')"))


@query("htm_24_enhanced_record", f"""
WITH {SCORES_SQL}, r AS (SELECT page_id, string_agg(link, ' ' ORDER BY o DESC, pos) AS top_links, count(*) AS n FROM (SELECT *, round(overall, 6) AS o, row_number() OVER (PARTITION BY page_id ORDER BY round(overall, 6) DESC, pos) AS rk FROM scored) WHERE rk <= 20 GROUP BY 1), {MAIN_SQL} SELECT page_id, title, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INT AS word_count, coalesce(n, 0) AS n_top_links, md5(coalesce(top_links, '')) AS links_md5, true AS has_markdown FROM main LEFT JOIN r USING (page_id)""")
def enhanced_record(t: Inputs):
    """Page record with pruned blocks, Markdown and the best twenty links, joined by page."""
    from ..functions import dom, markdown as M
    from ..operators.skew import top_per_key
    d = dom.parsed_pages(t)
    rec = P.page_record(d).select("page_id", "title", "word_count")
    md = d.select("page_id", M.render(F.col("body_text"), F.col("nodes"), F.col("url"), drop="title,head,nav,footer").alias("markdown"))
    kept = P.prune(P.blocks(d)).where("keep").groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"))
    top = top_per_key(scored_links(t).select("page_id", "link", "overall", "pos"), ["page_id"], [F.col("overall").desc(), F.col("pos")], 20)
    links = top.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_top_links"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "link"))), lambda x: x["link"]), " ").alias("links"))
    whole = rec.join(md, "page_id", "left").join(kept, "page_id", "left").join(links, "page_id", "left").fillna({"n_top_links": 0, "links": ""})
    return whole.select("page_id", "title", "word_count", "n_top_links", F.md5("links").alias("links_md5"), (F.length("markdown") > 0).alias("has_markdown"))
