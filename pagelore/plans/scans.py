"""Sources and sinks over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import digests as D
from ..functions import urls as U
from ..operators.skew import latest_per_key
from ..session import scratch_path, write_and_read
from ..sources import billing, cache, crawl_store, pdf_text, providers, sitemaps, snapshots
from .registry import Inputs, query

HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


@query("src_01_page_scan", f"""
SELECT page_id, url, sha256(html) AS html_sha FROM pages WHERE {HOST_SQL} LIKE '%.example.org'""")
def page_scan(t: Inputs):
    return t.pages.where(U.host(F.col("url")).endswith(".example.org")).select(
        "page_id", "url", D.sha256_hex(F.col("html")).alias("html_sha"))


@query("src_02_latest_record", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1""")
def latest_record(t: Inputs):
    return latest_per_key(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"],
                          [F.col("ts"), F.col("event_id")]).drop("ts")


@query("src_03_crawl_upsert", """
WITH base AS (SELECT substr(sha256(url || ':' || html), 1, 16) AS record_key, url, 0 AS version FROM pages),
inc AS (SELECT substr(sha256(url || ':' || html), 1, 16) AS record_key, url, 1 AS version FROM pages
        WHERE contains(url, '/en/')
        UNION ALL
        SELECT substr(sha256(url || ':' || html || ' '), 1, 16), url, 1 FROM pages WHERE contains(url, '/fr/'))
SELECT record_key, url, max(version) AS version FROM (SELECT * FROM base UNION ALL SELECT * FROM inc)
GROUP BY ALL""")
def crawl_upsert(t: Inputs):
    key = crawl_store.record_key(F.col("url"), F.col("html"))
    base = t.pages.select(key.alias("record_key"), "url", F.lit(0).alias("version"))
    edited = crawl_store.record_key(F.col("url"), F.concat("html", F.lit(" ")))
    inc = (t.pages.where(F.contains("url", F.lit("/en/"))).select(key.alias("record_key"), "url", F.lit(1).alias("version"))
           .unionByName(t.pages.where(F.contains("url", F.lit("/fr/")))
                        .select(edited.alias("record_key"), "url", F.lit(1).alias("version"))))
    return crawl_store.upsert(base, inc, ["record_key"])


@query("src_04_content_search", """
SELECT page_id, url FROM pages WHERE contains(url, 'utm_') OR contains(html, 'utm_')
ORDER BY page_id DESC LIMIT 20 OFFSET 3""")
def content_search(t: Inputs):
    return crawl_store.search(t.pages, "utm_", ["url", "html"], [F.col("page_id").desc()], 20, 3).select("page_id", "url")


@query("src_05_export", """
SELECT 'json' AS format, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type
UNION ALL SELECT 'csv', event_type, count(*), min(event_id) FROM events GROUP BY event_type""")
def export(t: Inputs):
    d = t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    out = None
    for fmt in ("json", "csv"):
        p = scratch_path(t.spark, f"export-{fmt}")
        crawl_store.export(d, p, fmt, [F.col("ts").desc(), F.col("event_id").desc()])
        back = t.spark.read.schema("event_id long, event_type string, ts string").format(fmt).option("header", True).load(p)
        g = back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")) \
            .select(F.lit(fmt).alias("format"), "event_type", "n", "first_id")
        out = g if out is None else out.unionByName(g)
    return out


def sitemap_docs(t: Inputs):
    """Sitemap documents made from the page table: (sitemap, body), and index documents (body)."""
    freq = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly", "yearly")]),
                        (F.col("page_id") % 4 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")), "yyyy-MM-dd")
    child = F.concat(F.lit("https://"), U.host(F.col("url")), F.lit("/sitemap.xml"))
    docs = t.pages.select(child.alias("sitemap"), sitemaps.urlset_xml(
        F.col("url"), day, freq, ((F.col("page_id") % 10) / 10).cast("string")).alias("body"))
    index = docs.select("sitemap").distinct().select(F.concat(
        F.lit("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>"), "sitemap",
        F.lit("</loc></sitemap></sitemapindex>")).alias("body"))
    return docs, index


SITEMAP_SQL = f"""SELECT url AS loc, strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%Y-%m-%d') AS lastmod,
  ['daily','weekly','monthly','yearly'][(page_id % 4 + 1)::INT] AS changefreq,
  round((page_id % 10) / 10, 6) AS priority, {HOST_SQL} AS host FROM pages"""


@query("src_06_sitemap", f"""
SELECT 'https://' || host || '/sitemap.xml' AS sitemap, loc, lastmod, changefreq, priority FROM ({SITEMAP_SQL})""")
def sitemap(t: Inputs):
    """Index entries expanded to the entries of their child sitemap."""
    docs, index = sitemap_docs(t)
    return sitemaps.parse_sitemaps(sitemaps.expand_index(index, "body", docs, "sitemap"), "body").select(
        "sitemap", "loc", "lastmod", "changefreq", "priority")


def robots_table(t: Inputs):
    h = t.pages.select(U.host(F.col("url")).alias("host")).distinct()
    return h.withColumn("body", F.concat(
        F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nuser-agent: another\nDisallow: /en/ # closed\nAllow: /en/5\nDisallow: /de\n"),
        F.lit("Disallow: /en/5?page=\nDisallow: /fr/1\nAllow: /fr/1?utm_source=feed\nUser-agent: third\nDisallow: /es\n"),
        F.lit("Sitemap: https://"), "host", F.lit("/sitemap.xml\nsitemap: https://"), "host", F.lit("/news.xml\n")))


@query("src_07_robots_sitemaps", f"""
WITH h AS (SELECT DISTINCT {HOST_SQL} AS host FROM pages)
SELECT host, 'https://' || host || '/sitemap.xml' AS sitemap_url FROM h
UNION ALL SELECT host, 'https://' || host || '/news.xml' FROM h""")
def robots_sitemaps(t: Inputs):
    return sitemaps.robots_sitemaps(robots_table(t))


@query("src_08_robots_check", """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/5?page=') THEN false WHEN starts_with(path, '/en/5') THEN true WHEN starts_with(path, '/en/') THEN false
  WHEN starts_with(path, '/de') THEN false WHEN starts_with(path, '/fr/1?utm_source=feed') THEN true WHEN starts_with(path, '/fr/1') THEN false ELSE true END AS allowed FROM p""")
def robots_check(t: Inputs):
    rules = sitemaps.robots_rules(robots_table(t))
    return sitemaps.allowed_by_robots(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


def provider_payloads(t: Inputs):
    """One provider answer per document, its layout chosen by id; two hits each."""
    layout = F.element_at(F.array(*[F.lit(x) for x in providers.LAYOUTS]), (F.col("doc_id") % 4 + 1).cast("int"))
    def hits(url, text, score):
        one = lambda u, ttl, s: F.struct(F.col(ttl).alias("title"), F.concat(F.lit(u), F.col("doc_id")).alias(url),
                                         F.col("text").alias(text), s.alias(score or "extra"))
        return F.array(one("https://a.example.org/", "source", F.lit(1.0)), one("https://b.example.org/", "lang", F.lit(2.0)))
    payload = None
    for name, (lst, url, text, score) in providers.LAYOUTS.items():
        p = F.to_json(F.struct(hits(url, text, score).alias(lst)))
        payload = F.when(F.col("layout") == name, p) if payload is None else payload.when(F.col("layout") == name, p)
    return (t.documents.withColumn("layout", layout).withColumn("payload", payload)
            .select(F.col("doc_id").alias("id"), F.col("layout").alias("provider"), "layout", "payload"))


@query("src_09_provider_layouts", """
WITH d AS (SELECT *, ['results_score','organic','organic_results','results_content'][(doc_id % 4 + 1)::INT] AS engine FROM documents)
SELECT doc_id AS id, 0 AS pos, source AS title, 'https://a.example.org/' || doc_id AS url, md5(text) AS text_md5, engine,
  CASE WHEN engine = 'results_content' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM d
UNION ALL SELECT doc_id, 1, lang, 'https://b.example.org/' || doc_id, md5(text), engine,
  CASE WHEN engine = 'results_content' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END FROM d""")
def provider_layouts(t: Inputs):
    n = providers.normalize_payloads(provider_payloads(t))
    return n.select("id", "pos", "title", "url", F.md5("description").alias("text_md5"), "engine", "score")


@query("src_10_hit_parsing", """
WITH d AS (SELECT doc_id, source, lang FROM documents)
SELECT doc_id, 1 AS rank, source AS title, 'https://x.example.org/' || doc_id AS url, 'about ' || lang AS snippet, lang AS engine FROM d
UNION ALL SELECT doc_id, 3, 'Untitled', 'https://y.example.org/' || doc_id, 'Fish & chips ' || source, source FROM d""")
def hit_parsing(t: Inputs):
    hit = lambda u, ttl, c, e: F.struct(ttl.alias("title"), F.concat(F.lit(u), F.col("doc_id")).alias("url"),
                                        c.alias("content"), F.array(e, F.lit("other")).alias("engines"))
    raw = F.array(hit("https://x.example.org/", F.concat(F.lit("<b>"), "source", F.lit("</b> ")), F.concat(F.lit("about  "), "lang"), F.col("lang")),
                  hit("https://x.example.org/", F.col("lang"), F.col("lang"), F.col("lang")),
                  hit("https://y.example.org/", F.lit(" "), F.concat(F.lit("Fish &amp; chips\n"), "source"), F.col("source")))
    return (t.documents.select("doc_id", providers.parse_hits(raw, F.col("lang")).alias("h"))
            .select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*"))


SNAP = """SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, octet_length(encode(any_value(text))) AS n_bytes
  FROM documents GROUP BY 1"""


@query("src_11_snapshot_sink", """
WITH s AS (SELECT DISTINCT sha256(text) AS content_sha256, octet_length(encode(text)) AS n_bytes FROM documents
  WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en'))
SELECT content_sha256, n_bytes, 'citations/' || substr(content_sha256,1,2) || '/' || substr(content_sha256,3,2) || '/' ||
  content_sha256 || '/snapshot.json' AS snapshot_key FROM s""")
def snapshot_sink(t: Inputs):
    rows = snapshots.snapshot_rows(t.documents, F.col("text")).select("content_sha256", "n_bytes", "snapshot_key", "lang")
    stored = rows.where("lang = 'en'")
    new = snapshots.new_snapshots(rows.drop("lang"), stored)
    p = scratch_path(t.spark, "citations")
    snapshots.write_snapshots(new, p)
    return t.spark.read.schema("content_sha256 string, n_bytes int, snapshot_key string").parquet(p).select(
        "content_sha256", "n_bytes", "snapshot_key")


@query("src_12_audit_scan", """
SELECT event_id, user_id AS api_key_id, event_type, strftime(ts, '%Y-%m-%d') AS dt FROM events
WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 2""")
def audit_scan(t: Inputs):
    p = scratch_path(t.spark, "audit")
    snapshots.write_audit(t.events.select(
        "event_id", F.col("user_id").alias("api_key_id"), "event_type",
        F.col("ts").cast("string").cast("timestamp_ntz").alias("created_at")), p)
    return snapshots.read_audit(
        t.spark, p, "event_id long, api_key_id long, event_type string, created_at timestamp_ntz, dt string",
        8, "2024-01-05", "2024-01-20", 50, 2).select("event_id", "api_key_id", "event_type", "dt")


@query("src_13_audit_rows", """
SELECT l_orderkey AS request_id, o_custkey AS api_key_id, count(*) AS n_refs,
  md5(string_agg('u' || l_linenumber || '/' || l_partkey || '/' || l_suppkey, ',' ORDER BY 'u' || l_linenumber || '/' || l_partkey || '/' || l_suppkey)) AS refs_md5
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def audit_rows(t: Inputs):
    """Requests are orders, references their lines; low priority orders stand for requests without a key."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("api_key_id"))
    refs = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("request_id"), "api_key_id",
        F.concat_ws("/", F.concat(F.lit("u"), "l_linenumber"), "l_partkey", "l_suppkey").alias("url"),
        F.lit("k").alias("snapshot_key"), F.lit("s").alias("content_sha256"), F.lit("t").alias("signed_at"))
    a = snapshots.audit_rows(refs, "request_id", "api_key_id")
    return a.select("request_id", "api_key_id", F.size("refs").cast("long").alias("n_refs"),
                    F.md5(F.array_join(F.transform("refs", lambda r: r["url"]), ",")).alias("refs_md5"))


@query("src_14_vector_upsert", """
WITH m AS (SELECT vec_id AS id, label AS namespace, 0 AS version FROM embeddings
  UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE label IN (3, 7))
SELECT namespace, id, max(version) AS version, md5(any_value(text)) AS text_md5, greatest(length(any_value(text)) - 2000, 0)::BIGINT AS over_limit
FROM m JOIN documents ON doc_id = id GROUP BY 1, 2""")
def vector_upsert(t: Inputs):
    """Vectors with metadata and their whole text; `over_limit` is what a limit of 2000 characters would cut."""
    v = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select(
        F.col("label").alias("namespace"), F.col("vec_id").alias("id"), F.col("text").alias("meta"))
    out = crawl_store.upsert(v.withColumn("version", F.lit(0)),
                             v.where(F.col("namespace").isin(3, 7)).withColumn("version", F.lit(1)), ["namespace", "id"])
    return out.select("namespace", "id", "version", F.md5("meta").alias("text_md5"), C.over(F.length("meta"), 2000).alias("over_limit"))


@query("src_15_embed_and_store", """
SELECT md5('https://' || source || '.example.org/' || doc_id) AS id, md5(source || chr(10) || chr(10) || text) AS text_md5,
  length(text) AS n_meta, 64 AS dims, greatest(length(text) - 2000, 0)::BIGINT AS over_text, greatest(length(text) - 500, 0)::BIGINT AS over_meta FROM documents""")
def embed_and_store(t: Inputs):
    """Text, id and metadata of whole texts, the vector from the encoder hook; what limits of 2000 and 500 characters would cut."""
    from ..functions.encoders import hashing_encoder
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")
    body = F.concat("source", F.lit("\n\n"), F.col("text"))
    return t.documents.select(F.md5(url).alias("id"), F.md5(body).alias("text_md5"),
                              F.length("text").cast("long").alias("n_meta"), F.size(hashing_encoder(body)).alias("dims"),
                              C.over(F.length("text"), 2000).alias("over_text"), C.over(F.length("text"), 500).alias("over_meta"))


@query("src_16_corpus_admin", """
SELECT label AS namespace, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1""")
def corpus_admin(t: Inputs):
    """Delete one corpus, then list the others with their sizes."""
    kept = write_and_read(t.embeddings.where("label <> 3").select("vec_id", "label"), "corpus")
    return kept.groupBy(F.col("label").alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


@query("src_17_cache_lookup", """
SELECT e.event_id, CASE WHEN d.doc_id IS NULL THEN 'miss' WHEN d.n_chars > 800 THEN 'hit' ELSE 'expired' END AS cache_status
FROM events e LEFT JOIN documents d ON e.user_id = d.doc_id AND d.lang = 'en'""")
def cache_lookup(t: Inputs):
    url = lambda c: cache.cache_key(F.concat(F.lit("https://example.org/"), c))
    store = t.documents.where("lang = 'en'").select(url(F.col("doc_id")).alias("key"), F.col("n_chars").alias("expires_at"))
    req = t.events.select("event_id", url(F.col("user_id")).alias("key"))
    return cache.lookup(req, store, "key", F.lit(800)).select("event_id", "cache_status")


@query("src_17_cache_fill", """
SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.user_id AND d.lang = 'en' AND d.n_chars > 800)""")
def cache_fill(t: Inputs):
    store = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("user_id"), F.col("n_chars").alias("expires_at"))
    return cache.rows_to_store(cache.lookup(t.events.select("user_id"), store, "user_id", F.lit(800)), "user_id")


@query("src_18_typed_copy", """
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS props FROM events WHERE event_type <> 'signup'""")
def typed_copy(t: Inputs):
    """JSON to text, booleans to 0/1, timestamps to ISO; rows already in the target are left out."""
    src = t.events.select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.to_json(F.from_json("props", "k int")).alias("props"))
    there = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("id"))
    return crawl_store.append_absent(there, src, ["id"])


NINE = ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "conversations")


@query("src_19_daily_snapshot", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NINE))
def daily_snapshot(t: Inputs):
    base = scratch_path(t.spark, "backup") + "/2024-01-31"
    out = None
    for n in NINE:
        df = getattr(t, n)
        df.write.json(f"{base}/{n}")
        c = t.spark.read.schema(df.schema).json(f"{base}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("src_20_charset_decode", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def charset_decode(t: Inputs):
    """Bytes decoded by the charset of their content type, UTF-8 where none is given."""
    raw = t.documents.select(
        "doc_id", F.when(F.col("lang") == "fr", "text/html; charset=UTF-16").otherwise("text/html").alias("content_type"),
        F.when(F.col("lang") == "fr", F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")).alias("body"))
    cs = F.upper(F.regexp_extract("content_type", r"charset=([\w-]+)", 1))
    text = None
    for name in ("UTF-16", "UTF-16BE", "UTF-16LE", "ISO-8859-1", "US-ASCII"):
        d = F.decode("body", name)
        text = F.when(cs == name, d) if text is None else text.when(cs == name, d)
    return raw.select("doc_id", F.md5(text.otherwise(F.decode("body", "UTF-8"))).alias("text_md5"))


def sniffed_type(header, body):
    h = F.lower(F.trim(F.split(header, ";")[0]))
    return (F.when(header.isNotNull() & (header != ""), h).when(body.startswith("%PDF"), "application/pdf")
            .when(F.ltrim(body).rlike(r"^\s*[{\[]"), "application/json").otherwise("text/html"))


@query("src_21_content_type", """
SELECT 'event' AS kind, event_id AS id, 'application/json' AS content_type FROM events
UNION ALL SELECT 'page', page_id, 'text/html' FROM pages
UNION ALL SELECT 'document', doc_id, CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'application/pdf' ELSE 'text/html' END FROM documents""")
def content_type(t: Inputs):
    a = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("h"), F.col("props").alias("b"))
    b = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit(None).cast("string").alias("h"), F.col("html").alias("b"))
    c = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
                           F.when(F.col("lang") == "en", "Text/Plain; charset=utf-8").alias("h"),
                           F.when(F.col("lang") == "de", F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")).alias("b"))
    return a.unionByName(b).unionByName(c).select("kind", "id", sniffed_type(F.col("h"), F.col("b")).alias("content_type"))


@query("src_23_pdf_pages", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c0 AS (SELECT doc_id, n, trim(regexp_replace(x, ' +', ' ', 'g')) AS x FROM p),
c AS (SELECT *, CASE WHEN length(x) < 100 AND x = upper(x) AND x <> lower(x) AND len(string_split(x, ' ')) < 10
  THEN '## ' || array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE x END AS m FROM c0)
SELECT doc_id, count(*) AS n_pages, md5(string_agg('CHAPTER ' || n || chr(10) || chr(10) || x, chr(10) || chr(10) ORDER BY n)) AS text_md5,
  md5(string_agg('## Chapter ' || n || chr(10) || chr(10) || m, chr(10) || chr(10) ORDER BY n)) AS markdown_md5 FROM c WHERE x <> '' GROUP BY doc_id""")
def pdf_pages(t: Inputs):
    """Every document line becomes a page with a capital heading and extraction noise, then cleaned and joined."""
    pages = (t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
             .where(F.trim("x") != "")
             .select("doc_id", "i", F.concat(F.lit("CHAPTER  "), F.col("i") + 1, F.lit("\n \n\n\n"), F.ltrim("x"), F.lit("�\x00 ")).alias("raw")))
    c = pages.select("doc_id", "i", pdf_text.clean_page(F.col("raw")).alias("text"))
    m = c.select("doc_id", "i", "text", pdf_text.page_markdown(F.col("text")).alias("md"))
    a = pdf_text.document_text(m, "doc_id", "i", "text").withColumnRenamed("text", "body")
    b = pdf_text.document_text(m, "doc_id", "i", "md").select("doc_id", F.col("text").alias("markdown"))
    return a.join(b, "doc_id").select("doc_id", "n_pages", F.md5("body").alias("text_md5"), F.md5("markdown").alias("markdown_md5"))


@query("src_23_pdf_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders""")
def pdf_dates(t: Inputs):
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'00'"))
    return t.orders.select("o_orderkey", F.date_format(pdf_text.pdf_date(raw), "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("src_24_request_log", """
SELECT l_orderkey AS request_id, count(*) AS results_count, count(*) FILTER (l_returnflag <> 'R') AS scraped_count,
  count(*) FILTER (l_returnflag = 'R') AS failed_count, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT AS content_length,
  bool_or(l_linestatus = 'F') AS cached FROM lineitem GROUP BY 1""")
def request_log(t: Inputs):
    ok = F.col("l_returnflag") != "R"
    return t.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.count(F.lit(1)).alias("results_count"), F.count_if(ok).alias("scraped_count"), F.count_if(~ok).alias("failed_count"),
        F.sum(F.when(ok, F.col("l_quantity")).otherwise(0)).cast("long").alias("content_length"),
        F.bool_or(F.col("l_linestatus") == "F").alias("cached"))


def billing_log(t: Inputs):
    """Subscription and invoice events made from orders: created, repeated, updated."""
    o = t.orders
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("F", "active", "O", "past_due", "P", "weird")]), F.col("o_orderstatus"))
    sub = F.to_json(F.struct(
        F.concat(F.lit("sub_"), "o_orderkey").alias("id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"),
        status.alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("unit_amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Scale plan").when(F.col("o_orderpriority") == "2-HIGH", "Pro").alias("plan_name"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 9000).alias("search_limit"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("current_period_start")))
    inv = F.to_json(F.struct(F.concat(F.lit("in_"), "o_orderkey").alias("id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"),
                             F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_due"),
                             F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paid"),
                             F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("paid_at")))
    row = lambda ev, seq, typ, p: F.struct(F.concat(F.lit(ev), "o_orderkey").alias("event_id"), F.lit(seq).alias("seq"),
                                           typ.alias("type"), p.alias("payload"))
    second = F.when(F.col("o_orderpriority") == "5-LOW", "customer.subscription.deleted").otherwise("customer.subscription.updated")
    return o.select(F.explode(F.array(
        row("a", 1, F.lit("customer.subscription.created"), sub), row("a", 1, F.lit("customer.subscription.created"), sub),
        row("b", 2, second, sub), row("c", 3, F.lit("invoice.paid"), inv), row("c", 3, F.lit("invoice.paid"), inv))).alias("e")).select("e.*")


def billing_users(t: Inputs):
    return t.customer.select(F.concat(F.lit("cus_"), "c_custkey").alias("customer"), F.col("c_custkey").alias("user_id"))


@query("src_25_billing_subscriptions", """
SELECT 'sub_' || o_orderkey AS id, c_custkey AS user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SCALE' WHEN '2-HIGH' THEN 'PRO' ELSE 'FREE' END AS plan_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'ACTIVE' WHEN o_orderstatus = 'O' THEN 'PAST_DUE' ELSE 'CANCELLED' END AS status,
  round(o_totalprice, 2) AS amount, CASE WHEN o_orderpriority = '2-HIGH' THEN 9000 ELSE 5000 END AS search_limit, 500 AS scrape_limit,
  '10/minute' AS rate_limit, strftime(o_orderdate, '%Y-%m-%d') AS period_start
FROM orders JOIN customer ON o_custkey = c_custkey""")
def billing_subscriptions(t: Inputs):
    s = billing.subscriptions(billing_log(t), billing_users(t))
    return s.withColumn("amount", F.round("amount", 2)).withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


@query("src_25_billing_invoices", """
SELECT 'in_' || o_orderkey AS id, c_custkey AS user_id, 'paid' AS status, round(o_totalprice * 100)::BIGINT AS amount_due,
  round(o_totalprice * 100)::BIGINT AS amount_paid, strftime(o_orderdate, '%Y-%m-%d') AS paid_at
FROM orders JOIN customer ON o_custkey = c_custkey""")
def billing_invoices(t: Inputs):
    return billing.invoices(billing_log(t), billing_users(t)).withColumn("paid_at", F.date_format("paid_at", "yyyy-MM-dd"))
