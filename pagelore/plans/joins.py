"""Joins over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..operators.skew import latest_per_key, nested, previous_row, top_per_key
from ..session import bucketed_once, write_and_read
from ..sources import crawl_store
from . import derived
from .derived import EDGE_SQL, ENTITY_SQL
from .registry import Inputs, query


def hits(t: Inputs):
    """Hits of a search: every page address, half with another trailing slash form, plus unknown addresses."""
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.rtrim("url", F.lit("/")), F.lit("/"))).otherwise(F.col("url"))
    return t.pages.select("page_id", u.alias("url"), F.concat(F.lit("snippet of "), "page_id").alias("snippet")).unionByName(
        t.pages.where("page_id % 5 = 0").select("page_id", F.concat("url", F.lit("/gone")).alias("url"), F.lit("lost page").alias("snippet")))


def scraped(t: Inputs):
    return t.pages.select("page_id", "url", "html", (F.col("page_id") % 3 != 0).alias("success"))


HITS_SQL = """hits AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN rtrim(url, '/') || '/' ELSE url END AS url, 'snippet of ' || page_id AS snippet FROM pages
  UNION ALL SELECT page_id, url || '/gone', 'lost page' FROM pages WHERE page_id % 5 = 0)"""


def attach_pages(h, p, cols):
    """Hits with the columns of the scraped page of their address; of several pages the last one counts."""
    key = lambda c: F.rtrim(c, F.lit("/"))
    ids = p.where("success").groupBy(key("url").alias("_k")).agg(F.max("page_id").alias("page_id"))
    right = p.select("page_id", *cols).join(ids, "page_id").drop("page_id")
    return h.withColumn("_k", key("url")).join(right, "_k", "left").drop("_k")


@query("join_01_hits_pages", f"""
WITH {HITS_SQL}, p AS (SELECT rtrim(url, '/') AS k, md5(arg_max(html, page_id)) AS h FROM pages WHERE page_id % 3 <> 0 GROUP BY 1)
SELECT hits.url, h AS html_md5, h IS NULL AS failed FROM hits LEFT JOIN p ON rtrim(hits.url, '/') = k""")
def hits_pages(t: Inputs):
    j = attach_pages(hits(t), scraped(t), ["html"])
    return j.select("url", F.md5("html").alias("html_md5"), F.col("html").isNull().alias("failed"))


@query("join_02_content_fallback", f"""
WITH {HITS_SQL}, p AS (SELECT rtrim(url, '/') AS k, arg_max(html, page_id) AS html FROM pages WHERE page_id % 3 <> 0 GROUP BY 1)
SELECT hits.url, md5(coalesce(html, snippet)) AS content_md5, len(list_filter(regexp_split_to_array(coalesce(html, snippet), '\\s+'), lambda x: x <> ''))::BIGINT AS n_words
FROM hits LEFT JOIN p ON rtrim(hits.url, '/') = k""")
def content_fallback(t: Inputs):
    c = F.coalesce("html", "snippet")
    return attach_pages(hits(t), scraped(t), ["html"]).select("url", F.md5(c).alias("content_md5"), X.word_count(c).cast("long").alias("n_words"))


@query("join_03_active_subscriptions", """
SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def active_subscriptions(t: Inputs):
    return t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query("join_04_user_children", """
SELECT c_custkey AS user_id, 'subscriptions' AS kind, count(o_orderkey) AS n, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS ids_md5
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
UNION ALL SELECT c_custkey, 'usage', count(event_id), md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id))
FROM customer JOIN events ON user_id = c_custkey GROUP BY 1""")
def user_children(t: Inputs):
    """Children nested per user and kind, one row each."""
    o = t.orders.select(F.col("o_custkey").alias("user_id"), F.lit("subscriptions").alias("kind"), F.col("o_orderkey").alias("id"))
    e = t.events.select("user_id", F.lit("usage").alias("kind"), F.col("event_id").alias("id"))
    c = nested(o.unionByName(e), ["user_id", "kind"], F.col("id"), F.col("id"), "ids")
    u = t.customer.select(F.col("c_custkey").alias("user_id"))
    return c.join(u, "user_id").select("user_id", "kind", F.size("ids").cast("long").alias("n"),
                                       F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("join_05_key_plan", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders WHERE o_orderstatus IN ('F','P'))
SELECT c_custkey AS key_id, coalesce(o_orderpriority, 'FREE') AS plan, CASE WHEN o_orderkey IS NULL THEN '10/minute' ELSE '60/minute' END AS rate_limit
FROM customer LEFT JOIN s ON o_custkey = c_custkey AND rn = 1 WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'""")
def key_plan(t: Inputs):
    cur = latest_per_key(t.orders.where("o_orderstatus IN ('F','P')").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"),
                         ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    keys = t.customer.where("c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'")
    return keys.join(cur, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("key_id"), F.coalesce("o_orderpriority", F.lit("FREE")).alias("plan"),
        F.when(F.col("o_orderkey").isNull(), "10/minute").otherwise("60/minute").alias("rate_limit"))


@query("join_06_unseen", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '/en/'))")
def unseen(t: Inputs):
    seen = t.pages.where(F.contains("url", F.lit("/en/"))).select("url")
    return t.pages.select("page_id", "url").join(seen, "url", "left_anti")


@query("join_07_idempotent_insert", "SELECT event_id, event_type FROM events WHERE user_id <> 3")
def idempotent_insert(t: Inputs):
    e = t.events.select("event_id", "event_type", "user_id")
    return crawl_store.append_absent(e.where("user_id = 3"), e.unionByName(e), ["event_id"]).select("event_id", "event_type")


@query("join_08_graph_semi", f"""
WITH e AS ({EDGE_SQL}), n AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > 5000 UNION SELECT 'p' || p_partkey FROM part WHERE p_size < 25)
SELECT 'touching' AS kind, src, dst FROM e WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n)
UNION ALL SELECT 'within', src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_semi(t: Inputs):
    n = t.supplier.where("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(
        t.part.where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    e = derived.edges(t)
    return J.edges_touching(e, n, "id").select(F.lit("touching").alias("kind"), "src", "dst").unionByName(
        J.edges_within(e, n, "id").select(F.lit("within").alias("kind"), "src", "dst"))


@query("join_09_people_search", """
WITH w AS (SELECT o_custkey, arg_max('org' || (o_orderkey % 7), o_orderkey) AS organisation FROM orders GROUP BY 1),
r AS (SELECT user_id, arg_max(event_type, event_id) AS role FROM events GROUP BY 1)
SELECT c_name AS name, organisation, role FROM customer LEFT JOIN w ON o_custkey = c_custkey LEFT JOIN r ON user_id = c_custkey
WHERE contains(lower(c_name), '00') AND organisation = 'org3'""")
def people_search(t: Inputs):
    """Persons by name part with their last employer and last role edge, filtered by organisation."""
    works = t.orders.groupBy("o_custkey").agg(F.max_by(F.concat(F.lit("org"), F.col("o_orderkey") % 7), "o_orderkey").alias("organisation"))
    role = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("role"))
    p = t.customer.where(F.contains(F.lower("c_name"), F.lit("00")))
    return (p.join(works, F.col("o_custkey") == F.col("c_custkey"), "left").join(role, F.col("user_id") == F.col("c_custkey"), "left")
            .where("organisation = 'org3'").select(F.col("c_name").alias("name"), "organisation", "role"))


@query("join_10_cross_reference")
def cross_reference(t: Inputs):
    """Matching mentions across documents (equal or Jaccard > 0.8); checked against brute force in the tests."""
    return J.cross_reference_matches(derived.entities(t))


@query("join_10_exact_pairs", f"""
WITH e AS ({ENTITY_SQL}), g AS (SELECT entity_type, lower(trim(value)) AS v, source_url, count(*) AS n FROM e WHERE entity_type = 'email' GROUP BY ALL),
p AS (SELECT entity_type, v, sum(n) AS t, sum(n * n) AS sq FROM g GROUP BY ALL)
SELECT entity_type, (sum(t * t - sq) / 2)::BIGINT AS matches FROM p GROUP BY 1""")
def exact_pairs(t: Inputs):
    """The same count for mail addresses, which have no clean tokens and so match by equality only."""
    return J.cross_reference_matches(derived.entities(t).where("entity_type = 'email'"))


@query("join_11_related_entities", f"""
WITH e AS ({ENTITY_SQL}), g AS (SELECT entity_type, lower(value) AS v, source_url, count(*) AS n FROM e WHERE entity_type = 'email' GROUP BY ALL)
SELECT a.entity_type, a.v AS a, b.v AS b, sum(a.n * b.n / CASE WHEN a.v = b.v THEN 2 ELSE 1 END)::BIGINT AS n_pairs FROM g a JOIN g b
ON a.entity_type = b.entity_type AND contains(b.v, a.v) AND a.source_url <> b.source_url GROUP BY ALL""")
def related_entities(t: Inputs):
    """Addresses that contain one another across documents, as value pairs with their mention pair count."""
    return J.related_sources(derived.entities(t).where("entity_type = 'email'"))


@query("join_12_cooccurrence", f"""
WITH e AS (SELECT *, 1 AS one FROM ({ENTITY_SQL}))
SELECT source_url, count(*) AS n_entities, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs, 0.6::DOUBLE AS confidence FROM e GROUP BY 1 HAVING count(*) > 1""")
def cooccurrence(t: Inputs):
    """Co-occurrence cliques: one row per source with its entity and pair count; the pairs stay implied."""
    return (derived.entities(t).groupBy("source_url").agg(F.count(F.lit(1)).alias("n_entities")).where("n_entities > 1")
            .select("source_url", "n_entities", (F.col("n_entities") * (F.col("n_entities") - 1) / 2).cast("long").alias("n_pairs"),
                    F.lit(0.6).alias("confidence")))


@query("join_12_neighbours", f"""
WITH e AS (SELECT DISTINCT value, source_url FROM ({ENTITY_SQL}) WHERE entity_type = 'email'),
d AS (SELECT source_url, count(*) AS k FROM e GROUP BY 1)
SELECT value, sum(k - 1)::BIGINT AS n_links, count(*) AS n_sources FROM e JOIN d USING (source_url) GROUP BY 1""")
def neighbours(t: Inputs):
    """Weighted degree of each address in the co-occurrence graph, from clique sizes."""
    e = derived.entities(t).where("entity_type = 'email'").select("value", "source_url").distinct()
    k = e.groupBy("source_url").agg(F.count(F.lit(1)).alias("k"))
    return e.join(k, "source_url").groupBy("value").agg(F.sum(F.col("k") - 1).alias("n_links"), F.count(F.lit(1)).alias("n_sources"))


@query("join_13_previous_version", """
SELECT doc_id, source, lag(doc_id) OVER w AS prev_doc_id, lag(md5(text)) OVER w AS prev_hash FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def previous_version(t: Inputs):
    d = t.documents.select("doc_id", "source", "lang", F.md5("text").alias("hash"))
    return previous_row(d, ["source", "lang"], F.floor(F.col("doc_id") / 5000), [F.col("doc_id")], ["doc_id", "hash"]).select(
        "doc_id", "source", "prev_doc_id", "prev_hash")


@query("join_13_asof", """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view')
SELECT p.event_id, v.view_id AS prev_event_id, v.view_value AS prev_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof(t: Inputs):
    """Each purchase with the last view of the same user before it."""
    e = t.events.select("event_id", "user_id", "ts", "value", "event_type")
    return J.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts",
                       F.date_trunc("day", "ts"), ["event_id", "value"]).select("event_id", "prev_event_id", "prev_value")


PERIODS = [(1, 10), (10, 20), (20, 32)]


@query("join_14_billing_period", """
WITH p AS (SELECT c_custkey, d[1] AS a, d[2] AS b, round(c_acctbal * d[1], 2) AS lim FROM customer, (SELECT unnest([[1,10],[10,20],[20,32]]) AS d))
SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m') AS month, a AS period, lim AS period_limit FROM events JOIN p ON user_id = c_custkey AND day(ts) >= a AND day(ts) < b""")
def billing_period(t: Inputs):
    p = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal", F.explode(F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PERIODS])).alias("p")).select(
        "user_id", F.col("p.a").alias("period"), F.col("p.b").alias("period_end"), F.round(F.col("c_acctbal") * F.col("p.a"), 2).alias("period_limit"))
    e = t.events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.dayofmonth("ts").alias("day"))
    return J.interval_join(e, p, ["user_id"], "day", "period", "period_end", salt_by=["event_id"]).select(
        "event_id", "month", "period", "period_limit")


@query("join_15_retention_rule", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '1h' WHEN l_returnflag = 'A' THEN '7d' WHEN l_returnflag = 'N' THEN '30d' ELSE '24h' END AS policy FROM lineitem""")
def retention_rule(t: Inputs):
    from ..operators.retention import policy_of
    rules = [{"data_type": "A", "tags": ["F"], "policy": "1h"}, {"data_type": "A", "policy": "7d"}, {"data_type": "N", "policy": "30d", "except": ["X"]},
             {"data_type": "R", "tags": ["none"], "policy": "0h"}]
    return t.lineitem.select("l_orderkey", "l_linenumber", policy_of(F.col("l_returnflag"), F.array("l_linestatus"), rules).alias("policy"))


@query("join_16_queries_documents", """
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (tok) GROUP BY ALL)
SELECT item_id, doc_id, shared, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def queries_documents(t: Inputs):
    q = t.benchmark.select("item_id", F.explode(F.array_distinct(X.index_tokens(F.col("text")))).alias("tok"))
    d = bucketed_once(t.spark, t.folder, "document_words", lambda deal: deal(t.documents).select("doc_id", F.explode(F.array_distinct(X.index_tokens(F.col("text")))).alias("tok")), "doc_id")
    s = d.join(write_and_read(q, "terms"), "tok").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return top_per_key(s, ["item_id"], [F.col("shared").desc(), F.col("doc_id")], 10)


@query("join_17_entity_relations", f"""
WITH e AS ({EDGE_SQL}), n AS (SELECT 's' || s_suppkey AS name FROM supplier WHERE s_nationkey < 5)
SELECT name, src, dst, rel, 'out' AS direction FROM n JOIN e ON name = src UNION ALL SELECT name, src, dst, rel, 'in' FROM n JOIN e ON name = dst""")
def entity_relations(t: Inputs):
    n = t.supplier.where("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("name"))
    return J.relations_of(n, derived.edges(t))


@query("join_18_cascade_delete", """
SELECT 'orders' AS name, count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)""")
def cascade_delete(t: Inputs):
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    orders_gone = t.orders.join(gone, F.col("o_custkey") == F.col("k"), "left_semi").select(F.col("o_orderkey").alias("k"))
    out = None
    for name, df, col, g in (("orders", t.orders, "o_custkey", gone), ("events", t.events, "user_id", gone), ("lineitem", t.lineitem, "l_orderkey", orders_gone)):
        kept = df.select(col).join(g, F.col(col) == F.col("k"), "left_anti").agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("name"), "kept")
        out = kept if out is None else out.unionByName(kept)
    return out
