"""Projections, filters and predicates over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as X
from ..functions import urls as U
from ..sources import cache, crawl_store
from .registry import Inputs, query

HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
QS = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
DEPTH = f"len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))"


@query("flt_01_domain", f"""
SELECT page_id, NOT contains({HOST}, 'spam') AND NOT contains({HOST}, 'pills') AND (contains({HOST}, 'example.com') OR contains({HOST}, 'example.org')) AS ok,
  {HOST} = 'ththed.example.org' AS same FROM pages""")
def domain(t: Inputs):
    u = F.col("url")
    return t.pages.select("page_id", U.domain_ok(u, ["example.com", "Example.org"], ["spam", "pills"]).alias("ok"),
                          U.domain_ok(u, same_domain="ththed.example.org").alias("same"))


@query("flt_02_url_pattern", """
SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'page=\\d') AND (regexp_matches(url, '/en/\\d+') OR regexp_matches(url, '\\.html$'))""")
def url_pattern(t: Inputs):
    return t.pages.where(U.pattern_ok(F.col("url"), [r"/en/\d+", r"\.html$"], [r"page=\d"])).select("page_id", "url")


EXT = "['.html','.PDF','.png','','.docx']"


@query("flt_03_content_type", f"""
WITH p AS (SELECT page_id, url || {EXT}[(page_id % 5 + 1)::INT] AS url, [NULL,'text/html; charset=utf-8','application/json'][(page_id % 3 + 1)::INT] AS ct FROM pages)
SELECT page_id, NOT regexp_matches(lower({PATH}), '\\.(pdf|docx|png)$') AND (ct IS NULL OR contains(ct, 'text/html')) AS ok FROM p""")
def content_type(t: Inputs):
    p = t.pages.select("page_id", F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".html", ".PDF", ".png", "", ".docx")]), (F.col("page_id") % 5 + 1).cast("int"))).alias("url"),
                       F.element_at(F.array(F.lit(None), F.lit("text/html; charset=utf-8"), F.lit("application/json")), (F.col("page_id") % 3 + 1).cast("int")).alias("ct"))
    return p.select("page_id", U.content_type_ok(F.col("url"), F.col("ct")).alias("ok"))


TAILS = ("/a/b/c/d", "?sid=1", "/admin/x", "?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=10&k=11", "", "x.php?a&b&c&d")


@query("flt_04_structure", f"""
WITH p AS (SELECT page_id, url || {list(TAILS)}[(page_id % 6 + 1)::INT] AS url FROM pages)
SELECT page_id, {DEPTH} <= 5 AND len(string_split({QS}, '&')) <= 10 AND
  NOT regexp_matches(url, '(?i)/cgi-bin/|/admin/|/private/|/tmp/|\\?.*sessionid|\\?.*sid=|\\?.*PHPSESSID|\\.php\\?.*&.*&.*&|javascript:|mailto:') AS ok FROM p""")
def structure(t: Inputs):
    u = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("page_id") % 6 + 1).cast("int")))
    return t.pages.select("page_id", U.structure_ok(u).alias("ok"))


@query("flt_05_url_relevance", """
WITH p AS (SELECT page_id, list_distinct(regexp_extract_all(lower(url), '[a-z]+')) AS w FROM pages)
SELECT page_id, round(len(list_intersect(['blog','example','feed','news'], w)) / 4, 6) AS overlap,
  len(list_intersect(['blog','example','feed','news'], w)) / 4 >= 0.3 AS ok FROM p""")
def url_relevance(t: Inputs):
    q = X.clean_tokens(X.words(F.lit("the Blog Example of FEED news")))
    u = F.col("url")
    return t.pages.select("page_id", F.round(U.query_overlap(u, q), 6).alias("overlap"), U.relevance_ok(u, q).alias("ok"))


def filter_chain(df, filters: dict):
    """Adds failed_filter (null when all pass): the first filter of the chain that rejects the row."""
    return df.withColumn("failed_filter", F.coalesce(*[F.when(~c, F.lit(n)) for n, c in filters.items()]))


def chain_stats(df, names: list[str]):
    """Per filter: rows that reached it and rows it rejected. One aggregate over the failed filter."""
    order = {n: i for i, n in enumerate(names)}
    pos = F.coalesce(*[F.when(F.col("failed_filter") == n, F.lit(i)) for n, i in order.items()], F.lit(len(names)))
    sums = [F.count_if(pos >= i).alias(f"seen_{i}") for i in range(len(names))] + [
        F.count_if(pos == i).alias(f"rej_{i}") for i in range(len(names))]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("filter"), F.col(f"seen_{i}").alias("seen"), F.col(f"rej_{i}").alias("rejected"))
        for n, i in order.items()])).alias("s")).select("s.*")


@query("flt_06_filter_chain", f"""
WITH f AS (SELECT contains({HOST}, 'spam') OR contains({HOST}, 'pills') AS d, regexp_matches(url, 'page=\\d') AS p, {PATH} LIKE '%.html' AS h FROM pages)
SELECT 'domain' AS filter, count(*) AS seen, count(*) FILTER (d) AS rejected FROM f
UNION ALL SELECT 'pattern', count(*) FILTER (NOT d), count(*) FILTER (NOT d AND p) FROM f
UNION ALL SELECT 'html', count(*) FILTER (NOT d AND NOT p), count(*) FILTER (NOT d AND NOT p AND h) FROM f""")
def chain(t: Inputs):
    u = F.col("url")
    c = filter_chain(t.pages, {"domain": U.domain_ok(u, blocked=["spam", "pills"]),
                               "pattern": U.pattern_ok(u, exclude=[r"page=\d"]), "html": U.extension(u) != "html"})
    return chain_stats(c, ["domain", "pattern", "html"])


@query("flt_07_site_scope", f"""
SELECT page_id FROM pages WHERE {HOST} LIKE '%example.org' AND starts_with({PATH}, '/en') AND NOT contains(url, 'ref=')""")
def site_scope(t: Inputs):
    return t.pages.where(U.site_scope_ok(F.col("url"), "https://example.org/en", by_path=True, exclude=["ref="])).select("page_id")


@query("flt_08_path_substrings", """
SELECT page_id FROM pages WHERE (contains(url, '/fr/') OR contains(url, '/de/')) AND NOT contains(url, '.html')""")
def path_substrings(t: Inputs):
    u = F.col("url")
    return t.pages.where(U.any_in(["/fr/", "/de/"], u) & ~U.any_in([".html"], u)).select("page_id")


@query("flt_09_preview_gate", f"""
SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'utm_') AND NOT contains({HOST}, 'spam') AND length(html) / 4000.0 >= 0.3 AND contains(url, 'blog')""")
def preview_gate(t: Inputs):
    u = F.col("url")
    scored = t.pages.select("page_id", "url", (F.length("html") / 4000.0).alias("quality"), F.when(F.contains(u, F.lit("blog")), 0.5).otherwise(0.1).alias("relevance"))
    return scored.where(U.pattern_ok(u, exclude=["utm_"]) & U.domain_ok(u, blocked=["spam"]) & (F.col("quality") >= 0.3) & (F.col("relevance") >= 0.2)).select("page_id")


@query("flt_10_href_limits", """
WITH a AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: NOT regexp_matches(x, '^(#|javascript:|mailto:)')) AS hrefs FROM pages)
SELECT page_id, len(hrefs)::BIGINT AS n_links, greatest(len(hrefs) - 200, 0)::BIGINT AS n_over, array_to_string(hrefs, ' ') AS hrefs FROM a""")
def href_limits(t: Inputs):
    """Links of a page, anchors and pseudo links left out, and how many a limit of 200 would leave out."""
    from ..functions import dom
    hrefs = F.transform(dom.elements(F.col("nodes"), "a[href]"), lambda n: n["attrs"]["href"])
    d = dom.parsed_pages(t).select("page_id", F.filter(hrefs, lambda h: ~h.rlike("^(?:#|javascript:|mailto:)")).alias("h"))
    n = F.size("h").cast("long")
    return d.select("page_id", n.alias("n_links"), F.greatest(n - 200, F.lit(0)).alias("n_over"), F.array_join("h", " ").alias("hrefs"))


@query("flt_11_tracking_pixel", """
SELECT l_orderkey, l_linenumber, (l_quantity::INT <= 3 OR l_linenumber <= 3) OR l_returnflag = 'R' AS pixel FROM lineitem""")
def tracking_pixel(t: Inputs):
    """Image tags made from order lines: quantity by line number pixels, one source domain is a tracker."""
    src = F.when(F.col("l_returnflag") == "R", "https://ad.doubleclick.net/x.gif").otherwise("https://img.example.org/x.gif")
    return t.lineitem.select("l_orderkey", "l_linenumber", C.tracking_pixel(
        src, F.concat(F.col("l_quantity").cast("int"), F.lit("px")), F.col("l_linenumber").cast("string")).alias("pixel"))


@query("flt_12_validation", """
WITH b AS (SELECT 'doc' AS kind, doc_id AS id, text AS q, NULL AS u FROM documents
  UNION ALL SELECT 'page', page_id, NULL, replace(url, 'https://m.', 'ftp://10.0.0.1/<') FROM pages)
SELECT kind, id, CASE WHEN kind = 'doc' THEN concat_ws(',', CASE WHEN trim(q) = '' THEN 'query_empty' END, CASE WHEN length(trim(q)) > 500 THEN 'query_too_long' END)
  ELSE CASE WHEN starts_with(u, 'ftp') THEN 'url_scheme,url_characters,url_private' ELSE '' END END AS reasons FROM b""")
def validation(t: Inputs):
    d = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), C.query_reasons(F.col("text")).alias("r"))
    u = F.replace("url", F.lit("https://m."), F.lit("ftp://10.0.0.1/<"))
    p = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), C.url_reasons(u).alias("r"))
    return d.unionByName(p).select("kind", "id", F.array_join("r", ",").alias("reasons"))


@query("flt_12_parameter_checks", """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'engine_unknown:3-medium' WHEN o_orderpriority = '5-LOW' THEN 'engines_empty' END,
  CASE WHEN o_orderstatus = 'P' THEN 'language_code' END, CASE WHEN o_totalprice < 5 THEN 'timeout_too_low' WHEN o_totalprice::INT > 120 THEN 'timeout_too_high' END,
  CASE WHEN o_custkey < 1 THEN 'max_results_too_low' WHEN o_custkey > 100 THEN 'max_results_too_high' END) AS reasons,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '3-MEDIUM' THEN 'bing,3-medium' ELSE 'bing,google' END AS engines FROM orders""")
def parameter_checks(t: Inputs):
    e = (F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit(" ")))
         .when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit("Bing"), F.col("o_orderpriority")))
         .otherwise(F.array(F.lit("Bing "), F.lit("google"), F.lit("bing"))))
    lang = F.when(F.col("o_orderstatus") == "P", "eng").otherwise("EN")
    r = F.concat(C.engine_reasons(e), C.language_reason(lang), C.range_reason("timeout", F.col("o_totalprice").cast("int")),
                 C.range_reason("max_results", F.col("o_custkey")))
    return t.orders.select("o_orderkey", F.array_join(r, ",").alias("reasons"), F.array_join(C.engines_normal(e), ",").alias("engines"))


BLOCKS = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS b FROM documents"


@query("flt_13_block_prefilter", f"""
WITH b AS ({BLOCKS}), w AS (SELECT doc_id, i, list_distinct(regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM b),
f AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN ['the','and','of'] ELSE ['de','la','der'] END AS kw FROM documents),
s AS (SELECT doc_id, i, len(list_intersect(w, kw)) / greatest(len(w) + 3 - len(list_intersect(w, kw)), 1) >= 0.3 AS pass FROM w JOIN f USING (doc_id))
SELECT doc_id, i::INT AS i FROM (SELECT *, bool_or(pass) OVER (PARTITION BY doc_id) AS any_pass FROM s) WHERE pass OR NOT any_pass""")
def block_prefilter(t: Inputs):
    """Blocks of a text by Jaccard with the filter words; when no block passes, all are kept. Row-local."""
    kw = F.when(F.col("lang") == "en", X.literal_set(["the", "and", "of"])).otherwise(X.literal_set(["de", "la", "der"]))

    def jaccard(b):
        w = F.array_distinct(X.index_tokens(b))
        return F.size(F.array_intersect(w, kw)) / F.greatest(F.size(F.array_union(w, kw)), F.lit(1))

    scored = F.transform(F.split("text", "\n"), lambda b, i: F.struct(i.alias("i"), jaccard(b).alias("s")))
    d = t.documents.select("doc_id", scored.alias("b")).withColumn("p", F.filter("b", lambda x: x["s"] >= 0.3))
    return d.select("doc_id", F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("b"))).alias("x")).select("doc_id", "x.i")


@query("flt_14_safe_url", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS safe FROM pages""")
def safe_url(t: Inputs):
    u = (F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^[a-z]+:", "gopher:"))
         .when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^([a-z]+)://[^/]*", "$1://192.168.0.7:80"))
         .when(F.col("page_id") % 4 == 2, F.regexp_replace("url", "^([a-z]+)://[^/]*", "$1://localhost")).otherwise(F.col("url")))
    return t.pages.select("page_id", U.is_safe(u).alias("safe"))


@query("flt_15_suspicious_request", """
SELECT event_id, event_type = 'error' OR event_type = 'view' AS suspicious FROM events""")
def suspicious_request(t: Inputs):
    ua = F.when(F.col("event_type") == "error", "SQLMap/1.7").otherwise("Mozilla/5.0")
    p = F.when(F.col("event_type") == "view", "/wp-admin/setup").otherwise("/search")
    return t.events.select("event_id", C.suspicious_request(ua, p).alias("suspicious"))


@query("flt_16_sanitize_input", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('<b>Select ' || text, '[<>"'']', '', 'g'),
  '(?i)\\b(UNION|SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\\b|--|/\\*|\\*/', '', 'g'), '(?i)\\b(SCRIPT|JAVASCRIPT|VBSCRIPT)\\b', '', 'g'))) AS clean_md5,
  md5(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[;''"\\\\]', '', 'g'))) AS query_md5,
  greatest(length(text) - 989, 0)::BIGINT AS over_limit FROM documents""")
def sanitize_input(t: Inputs):
    """Whole texts; `over_limit` is what a limit of 1000 characters would cut."""
    return t.documents.select("doc_id", C.over(F.length("text") + 11, 1000).alias("over_limit"), F.md5(C.sanitize_input(F.concat(F.lit("<b>Select "), "text"))).alias("clean_md5"),
                              F.md5(C.clean_query(F.col("text"))).alias("query_md5"))


@query("flt_17_mask_map", """
SELECT c_custkey, substr(c_name, 1, 4) || '****' || right(c_name, 4) AS token, '****' AS secret, c_mktsegment AS segment FROM customer""")
def mask_map(t: Inputs):
    m = C.mask(F.create_map(F.lit("Access_Token"), F.col("c_name"), F.lit("my_secret"), F.col("c_custkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")))
    return t.customer.select("c_custkey", m["Access_Token"].alias("token"), m["my_secret"].alias("secret"), m["segment"].alias("segment"))


RULES = [{"pattern": "*", "mode": "enabled", "ttl": 60, "priority": 0}, {"pattern": "type:web_http", "mode": "read_only", "priority": 5},
         {"pattern": "domain:example.org", "mode": "bypass", "ttl": 30, "priority": 7}, {"pattern": "utm_", "mode": "disabled", "priority": 9}]


@query("flt_18_cache_rules", f"""
SELECT page_id, CASE WHEN contains(url, 'utm_') THEN 'disabled' WHEN {HOST} LIKE '%.example.org' THEN 'bypass' WHEN starts_with(url, 'http://') THEN 'read_only' ELSE 'enabled' END AS mode,
  CASE WHEN {HOST} LIKE '%.example.org' THEN 30 ELSE 60 END AS ttl, true AS cacheable FROM pages""")
def cache_rules(t: Inputs):
    mode, ttl = C.cache_rule(F.col("url"), RULES)
    return t.pages.select("page_id", mode.alias("mode"), ttl.alias("ttl"), C.cacheable(F.col("url")).alias("cacheable"))


@query("flt_19_hook_match", """
SELECT event_id, 'all' AS hook FROM events UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'tagged' FROM events WHERE event_type IN ('click','view') AND user_id % 2 = 0""")
def hook_match(t: Inputs):
    tags = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array(F.lit("odd")))
    ev = F.col("event_type")
    hooks = {"all": (True, [], []), "errors": (True, ["error"], []), "tagged": (True, ["click", "view"], ["even"]), "off": (False, [], [])}
    hit = F.array_compact(F.array(*[F.when(C.hook_matches(ev, tags, *h), n) for n, h in hooks.items()]))
    return t.events.select("event_id", F.explode(hit).alias("hook"))


@query("flt_20_payload", """
SELECT doc_id, len(string_split(text, ' ')) AS results_count, contains(text, 'zzzz') AS has_errors,
  length(text)::BIGINT AS n_text, greatest(length(text) - 1000, 0)::BIGINT AS over_limit FROM documents""")
def payload(t: Inputs):
    """Whole texts; `over_limit` is what the limit of a large payload would cut."""
    p = C.shrink_payload({"results": F.split("text", " "), "text": F.col("text"), "errors": F.array(F.lit("zzzz"))}, {"text": "text"})
    j = F.from_json(p, "results_count long, text string, errors array<string>")
    return t.documents.select("doc_id", j["results_count"].alias("results_count"), F.coalesce(j["errors"].isNotNull(), F.lit(False)).alias("has_errors"),
                              F.length(j["text"]).cast("long").alias("n_text"), C.over(F.length("text"), 1000).alias("over_limit"))


@query("flt_21_cutoff_delete", """
SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS deleted FROM events""")
def cutoff_delete(t: Inputs):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    kept = crawl_store.drop_older(t.events, F.col("ts"), now, 10).select(F.lit(1).alias("k"))
    return kept.unionByName(t.events.select(F.lit(0).alias("k"))).agg(
        F.sum("k").cast("long").alias("kept"), (F.count_if(F.col("k") == 0) - F.sum("k")).alias("deleted"))


@query("flt_22_point_filters", """
SELECT 'errors' AS list, event_id AS id FROM events WHERE event_type = 'error' AND user_id = 7
UNION ALL SELECT 'invoices', o_orderkey FROM orders WHERE o_custkey = 42
UNION ALL SELECT 'plans', p_partkey FROM part WHERE p_size > 40 AND p_retailprice BETWEEN 905 AND 920""")
def point_filters(t: Inputs):
    return (t.events.where("event_type = 'error' AND user_id = 7").select(F.lit("errors").alias("list"), F.col("event_id").alias("id"))
            .unionByName(t.orders.where("o_custkey = 42").select(F.lit("invoices").alias("list"), F.col("o_orderkey").alias("id")))
            .unionByName(t.part.where("p_size > 40 AND p_retailprice BETWEEN 905 AND 920").select(F.lit("plans").alias("list"), F.col("p_partkey").alias("id"))))


@query("flt_23_invalidate", """
SELECT count(*) FILTER (NOT regexp_matches(url, '^http://.*\\.example\\.net/')) AS kept, count(*) FILTER (regexp_matches(url, '^http://.*\\.example\\.net/')) AS removed FROM pages""")
def invalidate(t: Inputs):
    kept = cache.invalidate(t.pages.select("url", F.lit(1).alias("k")), "url", r"^http://.*\.example\.net/")
    gone = t.pages.select("url", F.lit(0).alias("k"))
    return kept.unionByName(gone).agg(F.sum("k").alias("kept"), (F.count_if(F.col("k") == 0) - F.sum("k")).alias("removed"))
