"""Aggregations over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import aggregates as A
from ..operators.skew import top_per_key
from .registry import Inputs, query

HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
K = "CAST(json_extract(props, '$.k') AS INT)"


def k_of():
    return F.get_json_object("props", "$.k").cast("int")


def request_log(t: Inputs):
    """Events read as request log: value is the search time, k decides about the cache."""
    return t.events.select("event_id", "ts", "user_id", "event_type", F.col("value").alias("search_ms"),
                           (F.col("value") + k_of()).alias("total_ms"), (k_of() >= 50).alias("cache_hit"))


@query("agg_01_request_analytics", f"""
SELECT user_id, count(*) AS total, count(*) FILTER ({K} >= 50) AS cache_hits, round(avg(value), 6) AS avg_search_ms, round(avg(value + {K}), 6) AS avg_total_ms,
  round(count(*) FILTER ({K} >= 50) / count(*) * 100, 6) AS hit_rate FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1""")
def request_analytics(t: Inputs):
    a = A.request_analytics(request_log(t), F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"), by=["user_id"])
    return a.select("user_id", "total", "cache_hits", *[F.round(c, 6).alias(c) for c in ("avg_search_ms", "avg_total_ms", "hit_rate")])


@query("agg_02_top_queries", "SELECT text AS query, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def top_queries(t: Inputs):
    return A.top_values(t.conversations.where("role = 'user'").withColumnRenamed("text", "query"), "query")


@query("agg_03_engine_usage", f"""
SELECT engine, count(*) AS n FROM (SELECT unnest(string_split(event_type || ',' || CASE WHEN {K} > 70 THEN 'bing,google' ELSE 'google' END, ',')) AS engine FROM events) GROUP BY 1""")
def engine_usage(t: Inputs):
    """Engines held as a JSON array in the log."""
    j = F.to_json(F.array_union(F.array("event_type"), F.when(k_of() > 70, F.array(F.lit("bing"), F.lit("google"))).otherwise(F.array(F.lit("google")))))
    log = t.events.select(j.alias("engines"))
    return log.select(F.explode(F.from_json("engines", "array<string>")).alias("engine")).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query("agg_04_store_statistics", f"""
SELECT count(*) AS total, count(*) FILTER (page_id % 3 <> 0) AS success, count(*) FILTER (page_id % 3 = 0) AS failed,
  round(count(*) FILTER (page_id % 3 <> 0) / count(*) * 100, 6) AS success_rate, count(DISTINCT {HOST}) AS domains, round(avg(length(html)), 6) AS avg_length FROM pages""")
def store_statistics(t: Inputs):
    ok = F.col("page_id") % 3 != 0
    return t.pages.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"),
                       F.round(F.count_if(ok) / F.count(F.lit(1)) * 100, 6).alias("success_rate"),
                       F.count_distinct(U.host(F.col("url"))).alias("domains"), F.round(F.avg(F.length("html")), 6).alias("avg_length"))


@query("agg_05_top_domains", f"SELECT {HOST} AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def top_domains(t: Inputs):
    return A.top_values(t.pages.select(U.host(F.col("url")).alias("domain")), "domain", 20)


def page_links(t: Inputs):
    """Links of the pages, plus one external link per page taken from the next host in the page's path text."""
    from ..functions import dom
    p = dom.parsed_pages(t)
    a = p.select("page_id", "url", F.posexplode(dom.elements(F.col("nodes"), "a[href]")).alias("pos", "n"), "body_text")
    return a.select("page_id", "url", "pos", U.resolve(F.col("url"), F.col("n.attrs")["href"]).alias("link"),
                    F.trim(dom.text_of(F.col("body_text"), F.col("n"))).alias("anchor"))


LINK_SQL = f"""links AS (SELECT page_id, url, i - 1 AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link, anchor, {HOST} AS host FROM (
  SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages))"""


@query("agg_06_link_domains", f"""
WITH {LINK_SQL} SELECT page_id, count(DISTINCT host) AS n_domains, count(*) AS internal, 0::BIGINT AS external, any_value(host) AS top_domain FROM links GROUP BY 1""")
def link_domains(t: Inputs):
    links = page_links(t).withColumn("host", U.host(F.col("link"))).withColumn("ext", F.col("host") != U.host(F.col("url")))
    per = links.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("n"), F.count_if("ext").alias("n_ext"))
    top = top_per_key(per, ["page_id"], [F.col("n").desc(), F.col("host")], 10)
    agg = per.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_domains"), F.sum(F.col("n") - F.col("n_ext")).alias("internal"), F.sum("n_ext").alias("external"))
    best = top.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "host"))), lambda x: x["host"]), ",").alias("top_domain"))
    return agg.join(best, "page_id")


@query("agg_07_score_distribution", """
SELECT event_type, count(*) FILTER (s >= 0.8) AS excellent, count(*) FILTER (s >= 0.6 AND s < 0.8) AS good, count(*) FILTER (s >= 0.4 AND s < 0.6) AS average,
  count(*) FILTER (s >= 0.2 AND s < 0.4) AS poor, count(*) FILTER (s < 0.2) AS very_poor FROM (SELECT event_type, value / 20 AS s FROM events) GROUP BY 1""")
def score_distribution(t: Inputs):
    bands = ["excellent", "good", "average", "poor", "very_poor"]
    d = t.events.select("event_type", A.score_band(F.col("value") / 20).alias("band"))
    return d.groupBy("event_type").pivot("band", bands).count().fillna(0, bands)


@query("agg_08_link_summary", f"""
WITH {LINK_SQL} SELECT page_id, count(*) AS total_links, 0::BIGINT AS external_links, count(*) AS internal_links, count(DISTINCT host) AS unique_domains,
  round(avg(least(1.0, 0.6 + CASE WHEN length(anchor) > 10 AND NOT starts_with(anchor, 'http') THEN 0.2 ELSE 0 END)), 6) AS avg_score FROM links GROUP BY 1""")
def link_summary(t: Inputs):
    from ..functions.scoring import summary_link_score
    d = page_links(t).withColumn("host", U.host(F.col("link"))).withColumn("ext", F.col("host") != U.host(F.col("url")))
    return d.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total_links"), F.count_if("ext").alias("external_links"), F.count_if(~F.col("ext")).alias("internal_links"),
        F.count_distinct("host").alias("unique_domains"), F.round(F.avg(summary_link_score(F.col("host"), F.col("ext"), F.col("anchor"))), 6).alias("avg_score"))


@query("agg_09_discovery_breakdown", f"""
WITH u AS (SELECT CASE WHEN contains(url, '/en/') THEN 'sitemap' WHEN contains(url, '/fr/') THEN 'index' ELSE 'crawl' END AS source, {HOST} AS host FROM pages),
f AS (SELECT host, min(CASE source WHEN 'sitemap' THEN 1 WHEN 'index' THEN 2 ELSE 4 END) AS r FROM u GROUP BY 1)
SELECT source, count(*) AS found, (SELECT count(*) FROM f WHERE r = CASE source WHEN 'sitemap' THEN 1 WHEN 'index' THEN 2 ELSE 4 END) AS kept FROM u GROUP BY 1""")
def discovery_breakdown(t: Inputs):
    """Addresses by source before and after keeping each host once, best source first."""
    u = F.col("url")
    d = t.pages.select(F.when(F.contains(u, F.lit("/en/")), "sitemap").when(F.contains(u, F.lit("/fr/")), "index").otherwise("crawl").alias("source"), U.host(u).alias("host"))
    rank = F.when(F.col("source") == "sitemap", 1).when(F.col("source") == "index", 2).otherwise(4)
    one = d.groupBy("host").agg(F.min_by("source", rank).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("found")).join(one, "source", "left").fillna(0, ["kept"])


@query("agg_10_usage_upsert", """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m') AS period, event_type, count(*) AS n FROM events GROUP BY ALL),
d AS (SELECT user_id, strftime(ts, '%Y-%m') AS period, strftime(ts, '%d') AS day, count(*) AS n FROM events GROUP BY ALL),
a AS (SELECT user_id, period, sum(n)::BIGINT AS used, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_engine FROM e GROUP BY ALL)
SELECT a.*, by_day, greatest(used - 60, 0)::BIGINT AS overage FROM a JOIN (SELECT user_id, period, string_agg(day || '=' || n, ',' ORDER BY day) AS by_day FROM d GROUP BY ALL) USING (user_id, period)""")
def usage_upsert(t: Inputs):
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM").alias("period"), F.col("event_type").alias("engine"), F.date_format("ts", "dd").alias("day"))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return A.usage_upsert(e, F.lit(60)).select("user_id", "period", "used", flat("by_engine").alias("by_engine"), flat("by_day").alias("by_day"), "overage")


@query("agg_11_usage_report", """
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT d.user_id, sum(n)::BIGINT AS used, any_value(floor(c_acctbal)::BIGINT) AS usage_limit, greatest(any_value(floor(c_acctbal)::BIGINT) - sum(n), 0)::BIGINT AS remaining, any_value(c_acctbal < 0) AS unlimited,
  coalesce(sum(n) FILTER (day = '2024-01-15'), 0)::BIGINT AS today, string_agg(day || ':' || n, ' ' ORDER BY day) AS series FROM d JOIN customer ON user_id = c_custkey GROUP BY 1""")
def usage_report(t: Inputs):
    d = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    per = d.groupBy("user_id").agg(F.sum("n").alias("used"), F.coalesce(F.sum(F.when(F.col("day") == "2024-01-15", F.col("n"))), F.lit(0)).alias("today"),
                                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: F.concat(x["day"], F.lit(":"), x["n"])), " ").alias("series"))
    lim = t.customer.select(F.col("c_custkey").alias("user_id"), F.floor("c_acctbal").alias("usage_limit"), (F.col("c_acctbal") < 0).alias("unlimited"))
    return per.join(lim, "user_id").select("user_id", "used", "usage_limit", F.greatest(F.col("usage_limit") - F.col("used"), F.lit(0)).alias("remaining"), "unlimited", "today", "series")


@query("agg_12_grouping_sets", """
SELECT user_id, event_type AS engine, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
GROUP BY GROUPING SETS ((user_id, event_type), (user_id, strftime(ts, '%Y-%m-%d')), (user_id))""")
def grouping_sets(t: Inputs):
    e = t.events.select("user_id", F.col("event_type").alias("engine"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.groupingSets([["user_id", "engine"], ["user_id", "day"], ["user_id"]], "user_id", "engine", "day").agg(F.count(F.lit(1)).alias("n"))


@query("agg_13_address_quota", """
SELECT c_nationkey AS ip, coalesce(sum(CASE WHEN c_mktsegment <> 'MACHINERY' AND (c_acctbal < 0 OR c_acctbal > 3000) THEN c_custkey END), 0)::BIGINT AS used FROM customer GROUP BY 1""")
def address_quota(t: Inputs):
    """Use per address over unclaimed users whose reset is missing (negative) or later than today (3000)."""
    counted = (F.col("c_mktsegment") != "MACHINERY") & ((F.col("c_acctbal") < 0) | (F.col("c_acctbal") > 3000))
    return t.customer.groupBy(F.col("c_nationkey").alias("ip")).agg(F.coalesce(F.sum(F.when(counted, F.col("c_custkey"))), F.lit(0)).alias("used"))


@query("agg_14_crawl_monitor", f"""
WITH s AS (SELECT user_id, event_type <> 'error' AS ok, value AS ms, {K} AS bytes, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events),
q AS (SELECT user_id, sec, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS total, round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate, min(ms) AS min_ms, max(ms) AS max_ms, round(avg(ms) + 1e-9, 6) AS avg_ms, sum(bytes)::BIGINT AS bytes,
  (SELECT max(n) FROM q WHERE q.user_id = s.user_id) AS peak_per_sec, round(count(*) / (max(sec) - min(sec) + 1), 6) AS throughput FROM s GROUP BY user_id""")
def crawl_monitor(t: Inputs):
    s = t.events.select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), k_of().alias("bytes"),
                        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    m = A.monitor_summary(s, "user_id")
    return m.select("user_id", "total", F.round("success_rate", 6).alias("success_rate"), "min_ms", "max_ms", F.round(F.col("avg_ms") + 1e-9, 6).alias("avg_ms"), "bytes",
                    "peak_per_sec", F.round("throughput", 6).alias("throughput"))


@query("agg_14_error_histogram", f"""
WITH c AS (SELECT user_id, 'code' || {K} % 10 AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, code) AS rk FROM c)
SELECT user_id, string_agg(code || '=' || n, ',' ORDER BY code) AS histogram FROM r WHERE rk <= 5 GROUP BY 1""")
def error_histogram(t: Inputs):
    e = t.events.where("event_type = 'error'").select("user_id", F.concat(F.lit("code"), k_of() % 10).alias("code"))
    return A.histogram_map(e, "user_id", "code", 5).select("user_id", F.array_join(F.transform(
        F.map_entries("histogram"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("histogram"))


@query("agg_15_alerts", f"""
WITH m AS (SELECT user_id, max({K}) AS cpu, avg({K}) * 1.7 AS memory, count(*) AS total, count(*) FILTER (event_type IN ('click','view')) / count(*) * 100 AS success_rate FROM events GROUP BY 1)
SELECT user_id, 'high_cpu' AS alert FROM m WHERE cpu > 90 UNION ALL SELECT user_id, 'high_memory' FROM m WHERE memory > 85
UNION ALL SELECT user_id, 'low_success_rate' FROM m WHERE total > 10 AND success_rate < 50""")
def alerts(t: Inputs):
    m = t.events.groupBy("user_id").agg(F.max(k_of()).alias("cpu"), (F.avg(k_of()) * 1.7).alias("memory"), F.count(F.lit(1)).alias("total"),
                                        (F.count_if(F.col("event_type").isin("click", "view")) / F.count(F.lit(1)) * 100).alias("success_rate"))
    return A.alerts(m).select("user_id", "alert")


@query("agg_15_recommendations", """
WITH m AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') / count(*) * 100 AS sr, avg(value) / 2 AS s FROM events GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN total > 10 AND sr < 70 THEN 'check_connectivity' END, CASE WHEN total > 10 AND sr >= 70 AND sr < 90 THEN 'add_retries' END,
  CASE WHEN s > 5 THEN 'reduce_concurrency' END, CASE WHEN (100 - sr) / 100 > 0.1 THEN 'frequent_error' END) AS advice FROM m""")
def recommendations(t: Inputs):
    m = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), (F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)) * 100).alias("sr"), (F.avg("value") / 2).alias("s"))
    return m.select("user_id", F.array_join(A.recommendations(F.col("total"), F.col("sr"), F.col("s"), (100 - F.col("sr")) / 100), ",").alias("advice"))


@query("agg_16_service_rates", f"""
SELECT service, count(*) AS total, count(*) FILTER (ok) AS ok, round(avg(value), 6) AS average, round(count(*) FILTER (ok) / greatest(1, count(*)), 6) AS rate FROM
 (SELECT ['mapping','tracking','webhook','retention','batch','extraction','crawl','provider'][({K} % 8 + 1)::INT] AS service, event_type <> 'error' AS ok, value FROM events) GROUP BY 1""")
def service_rates(t: Inputs):
    names = ["mapping", "tracking", "webhook", "retention", "batch", "extraction", "crawl", "provider"]
    log = t.events.select(F.element_at(F.array(*[F.lit(n) for n in names]), k_of() % 8 + 1).alias("service"), "event_type", "value")
    return A.service_rates(log, "service", F.col("event_type") != "error", "value").select(
        "service", "total", "ok", F.round("average", 6).alias("average"), F.round("rate", 6).alias("rate"))


@query("agg_17_cache_statistics", f"""
SELECT user_id AS domain, count(*) FILTER ({K} < 40) AS hits, count(*) FILTER ({K} BETWEEN 40 AND 79) AS misses, count(*) FILTER ({K} >= 80) AS bypassed,
  round(count(*) FILTER ({K} < 40) / count(*), 6) AS hit_rate, round(coalesce(sum(value) FILTER ({K} < 40), 0), 4) AS time_saved FROM events GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 25""")
def cache_statistics(t: Inputs):
    k = k_of()
    g = t.events.groupBy(F.col("user_id").alias("domain")).agg(
        F.count_if(k < 40).alias("hits"), F.count_if(k.between(40, 79)).alias("misses"), F.count_if(k >= 80).alias("bypassed"),
        F.round(F.count_if(k < 40) / F.count(F.lit(1)), 6).alias("hit_rate"), F.round(F.coalesce(F.sum(F.when(k < 40, F.col("value"))), F.lit(0.0)), 4).alias("time_saved"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "domain").limit(25).drop("n")


@query("agg_18_latency_percentiles", """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_share,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(t: Inputs):
    b = A.latency_buckets(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", F.col("event_type") == "error", "6 hours", exact=True)
    return b.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "requests", *[F.round(c, 6).alias(c) for c in ("error_share", "p50", "p95", "p99")])


@query("agg_19_compliance_report", """
SELECT count(*) AS total, count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-30') AS expired, sum(floor(o_totalprice))::BIGINT AS bytes,
  count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-30' AND o_orderpriority <> '1-URGENT') AS violations,
  round(greatest(0, 1 - count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-30' AND o_orderpriority <> '1-URGENT') / count(*)), 6) AS score FROM orders""")
def compliance_report(t: Inputs):
    from ..operators import retention as R
    r = t.orders.select("o_orderkey", "o_orderpriority", F.floor("o_totalprice").alias("size_bytes"), R.expires_at(F.col("o_orderdate"), F.lit("24h")).alias("expires_at"))
    q = r.where("o_orderpriority = '1-URGENT'")
    return R.compliance(r, q, "o_orderkey", F.lit("1996-06-30 12:00:00").cast("timestamp_ntz")).withColumn("score", F.round("score", 6))


@query("agg_20_entity_validation", """
WITH e AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'email' WHEN 'O' THEN 'phone' ELSE 'url' END AS entity_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0.4 ELSE 0.8 END AS confidence, o_orderpriority LIKE '1%' AS bad FROM orders)
SELECT entity_type, count(*) FILTER (NOT bad AND confidence >= 0.5) AS valid, count(*) FILTER (bad OR confidence < 0.5) AS invalid,
  round(count(*) FILTER (NOT bad AND confidence >= 0.5) / count(*) * 0.7 + 30 / 100 * 0.3, 6) AS consistency FROM e GROUP BY 1""")
def entity_validation(t: Inputs):
    from ..operators.entities import validate
    bad = F.col("o_orderpriority").startswith("1")
    v = (F.when(F.col("o_orderstatus") == "F", F.when(bad, "no address").otherwise(F.concat(F.lit("u"), "o_orderkey", F.lit("@example.org"))))
         .when(F.col("o_orderstatus") == "O", F.when(bad, "12-34").otherwise("555-123-4567")).otherwise(F.when(bad, "nowhere").otherwise("https://example.org/x")))
    e = t.orders.select(F.when(F.col("o_orderstatus") == "F", "email").when(F.col("o_orderstatus") == "O", "phone").otherwise("url").alias("entity_type"),
                        v.alias("value"), F.when(F.col("o_orderpriority") == "5-LOW", 0.4).otherwise(0.8).alias("confidence"))
    return validate(e, F.lit(30)).withColumn("consistency", F.round("consistency", 6))


TOK = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@query("agg_21_term_statistics", f"""
WITH t AS (SELECT doc_id, {TOK} AS tok FROM documents) SELECT tok, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1 ORDER BY tf DESC, tok LIMIT 20""")
def term_statistics(t: Inputs):
    """Corpus term and document frequency, top twenty. Counting per (term, document) first keeps hot terms cheap."""
    tok = t.spread("documents").select("doc_id", F.explode(X.index_tokens(F.col("text"))).alias("tok"))
    per = tok.groupBy("tok", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tok").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")).orderBy(F.col("tf").desc(), "tok").limit(20)


@query("agg_21_new_terms", f"""
WITH t AS (SELECT doc_id, {TOK} AS tok FROM documents), f AS (SELECT tok, min(doc_id) AS doc_id FROM t GROUP BY 1)
SELECT doc_id, count(*) AS tokens, count(DISTINCT tok) AS terms, (SELECT count(*) FROM f WHERE f.doc_id = t.doc_id) AS new_terms FROM t GROUP BY 1""")
def new_terms(t: Inputs):
    tok = t.spread("documents").select("doc_id", F.explode(X.index_tokens(F.col("text"))).alias("tok"))
    return A.first_seen_terms(tok, "doc_id", "doc_id")


@query("agg_22_chunk_statistics", """
WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS chunk FROM documents)
SELECT doc_id, count(*) AS chunks, any_value(n) AS original_length, round(avg(length(chunk)), 6) AS avg_length FROM c GROUP BY 1""")
def chunk_statistics(t: Inputs):
    c = F.split("text", "\n")
    total = F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    return t.documents.select("doc_id", F.size(c).cast("long").alias("chunks"), F.length("text").cast("long").alias("original_length"),
                              F.round(total / F.size(c), 6).alias("avg_length"))


@query("agg_23_job_progress", f"""
WITH r AS (SELECT *, {K} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, count(*) FILTER (k < 70) AS completed, count(*) FILTER (k BETWEEN 70 AND 89) AS failed, count(*) FILTER (k >= 90) AS skipped, round(count(*) / 500 * 100, 6) AS percent,
  round(count(*) / sum(value) * 60, 4) AS per_minute, round((500 - count(*)) * avg(value) FILTER (rn <= 10), 4) AS eta_seconds FROM r GROUP BY 1""")
def job_progress(t: Inputs):
    k = k_of()
    u = t.events.select("user_id", "event_id", "value", F.when(k < 70, "ok").when(k < 90, "failed").otherwise("skipped").alias("status"), F.lit(500).alias("planned"))
    p = A.progress(u, "user_id", "status", "value", "event_id", "planned")
    return p.withColumns({"percent": F.round("percent", 6), "per_minute": F.round("per_minute", 4), "eta_seconds": F.round("eta_seconds", 4)})


@query("agg_24_key_findings", """
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || '- '), chr(10)), lambda x: trim(x)),
  lambda x: regexp_matches(x, '^[0-9\\-•]') AND length(x) > 20 AND length(x) < 300) AS f FROM documents)
SELECT doc_id, len(f) AS n, md5(array_to_string(f, '|')) AS findings_md5, greatest(len(f) - 10, 0) AS over_limit FROM f""")
def key_findings(t: Inputs):
    f = A.key_findings(F.replace("text", F.lit(". "), F.lit(".\n- ")))
    return t.documents.select("doc_id", F.size(f).cast("long").alias("n"), F.md5(F.array_join(f, "|")).alias("findings_md5"), F.greatest(F.size(f) - 10, F.lit(0)).cast("long").alias("over_limit"))


@query("agg_25_json_leaves", """
SELECT doc_id, len(string_split(text, chr(10))) + 2 AS leaves FROM documents""")
def json_leaves(t: Inputs):
    """Leaves of nested JSON; the schema is not known, so the text is walked in an Arrow function."""
    from ..functions.jsonwalk import count_leaves
    j = F.to_json(F.struct(F.struct("lang", F.struct("source").alias("in")).alias("meta"), F.split("text", "\n").alias("lines")))
    return t.documents.select("doc_id", count_leaves(j).cast("long").alias("leaves"))


@query("agg_26_credits", f"""
SELECT user_id, sum(1 + ({K} > 50)::INT + CASE WHEN event_type = 'view' THEN CASE WHEN value > 10 THEN 2 ELSE 1 END ELSE 0 END + (event_type = 'click')::INT)::BIGINT AS credits FROM events GROUP BY 1""")
def credits(t: Inputs):
    c = A.credits(k_of() > 50, F.col("event_type") == "view", F.col("value") > 10, F.col("event_type") == "click")
    return t.events.groupBy("user_id").agg(F.sum(c).alias("credits"))


@query("agg_27_invoice_totals", """
WITH r AS (SELECT o_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, sum(cents)::BIGINT AS total_cents, count(*) AS n, sum(cents) FILTER (rn <= 5)::BIGINT AS latest_cents FROM r GROUP BY 1""")
def invoice_totals(t: Inputs):
    """Totals of all invoices and of the latest five; the window only sees the five best per task and key."""
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    last = top_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5).groupBy("o_custkey").agg(F.sum("cents").alias("latest_cents"))
    return o.groupBy("o_custkey").agg(F.sum("cents").alias("total_cents"), F.count(F.lit(1)).alias("n")).join(last, "o_custkey")
