"""Scalar functions over whole columns of the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import dates as DT
from ..functions import digests as D
from ..functions import jsonwalk as JW
from ..functions import prompts as P
from ..functions import text as X
from ..functions import urls as U
from ..operators.skew import top_per_key
from .registry import Inputs, query

WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+"
SAN = ("trim(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', '', 'g'), '[\\x{{00}}-\\x{{08}}\\x{{0B}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]|\\p{{Cf}}|\\p{{Co}}', '', 'g'), "
       "'" + WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))")
ENT = "replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("sca_01_sanitize", f"""
SELECT 'doc' AS kind, doc_id AS id, md5({SAN.format('text')}) AS clean_md5 FROM documents UNION ALL SELECT 'page', page_id, md5({SAN.format(ENT)}) FROM pages""")
def sanitize(t: Inputs):
    return t.spread("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.md5(X.sanitize(F.col("text"))).alias("clean_md5")).unionByName(
        t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.md5(X.sanitize(F.col("html"), full_entities=True)).alias("clean_md5")))


@query("sca_02_clean_text", f"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower({SAN.format('text')}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '{WS}', ' ', 'g'))) AS clean_md5 FROM documents""")
def clean_text(t: Inputs):
    return t.spread("documents").select("doc_id", F.md5(X.clean(F.col("text"), True, True)).alias("clean_md5"))


STOP = {k: "[" + ",".join(f"'{w}'" for w in v) + "]" for k, v in X.STOP_WORDS.items()}


@query("sca_03_clean_tokens", f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(string_split({SAN.format('text')}, ' '), lambda x: lower(x)), lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}') AND NOT list_contains({STOP['en']}, x)) AS w FROM documents)
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM w""")
def clean_tokens(t: Inputs):
    w = X.clean_tokens(X.words(X.sanitize(F.col("text"))))
    return t.spread("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query("sca_04_entities", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), '|') AS emails,
  array_to_string(regexp_extract_all(text, '[\+]?[(]?[0-9]{1,4}[)]?[-\s\./0-9]{7,}'), '|') AS phones,
  array_to_string(regexp_extract_all(text, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') || regexp_extract_all(text, '\d{4}[/-]\d{1,2}[/-]\d{1,2}')
    || regexp_extract_all(text, '(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}'), '|') AS dates,
  array_to_string(regexp_extract_all(text, '[\$€£¥]\s*\d+(?:,\d{3})*(?:\.\d{2})?'), '|') AS currencies FROM documents""")
def entities(t: Inputs):
    d = t.spread("documents").select("doc_id", X.entities(F.col("text")).alias("e"))
    return d.select("doc_id", *[F.array_join(F.col("e")[k], "|").alias(n) for k, n in (
        ("emails", "emails"), ("phone_numbers", "phones"), ("dates", "dates"), ("currencies", "currencies"))])


@query("sca_05_snippet")
def snippet(t: Inputs):
    """Snippet of each document for the words of its benchmark text; checked against a restatement in the tests."""
    q = t.benchmark.select(F.col("item_id").alias("_q"), F.col("text").alias("query"))
    d = t.spread("documents").withColumn("_q", F.col("doc_id") % t.benchmark.agg(F.count(F.lit(1))).scalar())
    return d.join(q, "_q").select("doc_id", X.snippet(F.col("text"), F.col("query")).alias("snippet"))


def _lang_sql():
    n = {k: f"len(list_filter(w, lambda x: list_contains({v}, x)))" for k, v in STOP.items()}
    rows = ",".join(f"{n[k]} * 4 + {i}" for i, k in enumerate(sorted(n)))
    return f"""WITH w AS (SELECT doc_id, lang, length(text) AS l, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents),
b AS (SELECT *, list_max([{rows}]) AS b FROM w) SELECT doc_id, CASE WHEN l >= 20 AND b >= 4 THEN {sorted(n)}[(b % 4 + 1)::INT] END AS detected FROM b"""


@query("sca_06_language", _lang_sql())
def language(t: Inputs):
    return t.spread("documents").select("doc_id", X.language_of(F.col("text")).alias("detected"))


@query("sca_07_quality")
def quality(t: Inputs):
    """Text quality; the sentence boundary needs look-behind, so a plain restatement checks it in the tests."""
    return t.spread("documents").select("doc_id", F.round(X.quality_score(F.col("text")), 6).alias("quality"))


@query("sca_08_keywords", f"""
WITH t AS (SELECT doc_id, lang, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1) AS i, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, min(i) AS p FROM t WHERE length(w) > 3 AND NOT list_contains({STOP['en']}, w) GROUP BY ALL)
SELECT doc_id, string_agg(w, ' ' ORDER BY n DESC, p) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rn FROM c) WHERE rn <= 10 GROUP BY 1""")
def keywords(t: Inputs):
    tok = t.by_id("documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("p", "w"))
    tok = tok.where((F.length("w") > 3) & ~F.col("w").isin(X.STOP_WORDS["en"]))
    c = tok.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    top = top_per_key(c, ["doc_id"], [F.col("n").desc(), F.col("p")], 10)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), " ").alias("keywords"))


@query("sca_09_truncate", """
WITH h AS (SELECT doc_id, text, substr(text, 1, 77) AS h FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN instr(reverse(h), ' ') = 0 THEN h || '...' ELSE substr(h, 1, 77 - instr(reverse(h), ' ')) || '...' END AS short FROM h""")
def truncate(t: Inputs):
    return t.spread("documents").select("doc_id", X.truncate_words(F.col("text"), 80).alias("short"))


@query("sca_10_normalize_url", """
WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'gclid=1&z=2' ELSE url END AS u FROM pages),
v AS (SELECT page_id, regexp_replace(regexp_replace(u, '/+$', ''), '[?&](utm_source|utm_medium|utm_campaign|utm_content|utm_term|fbclid|gclid)=[^&]*', '', 'g') AS u FROM u)
SELECT page_id, regexp_replace(u, '[?&]+$', '') AS strict_url, regexp_replace(CASE WHEN contains(u, '?') THEN u ELSE regexp_replace(u, '^([^&]*)&', '\\1?') END, '[?&]+$', '') AS url FROM v""")
def normalize_url(t: Inputs):
    u = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("gclid=1&z=2"))).otherwise(F.col("url"))
    return t.pages.select("page_id", U.normalize(u, strict=True).alias("strict_url"), U.normalize(u).alias("url"))


@query("sca_11_map_normalize", """
SELECT page_id, lower(replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', ''), '://www.', '://')) AS url FROM pages""")
def map_normalize(t: Inputs):
    return t.pages.select("page_id", U.map_normalize(F.col("url")).alias("url"))


@query("sca_12_resolve", """
WITH b AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
x AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS dir FROM b)
SELECT page_id, '/a/c?x=../y' AS ref, root || '/a/c?x=../y' AS resolved FROM x UNION ALL SELECT page_id, 'img/../z.png', root || dir || 'z.png' FROM x
UNION ALL SELECT page_id, '//cdn.example.org/l.js', regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.org/l.js' FROM x UNION ALL SELECT page_id, '?q=1', root || p || '?q=1' FROM x
UNION ALL SELECT page_id, '#s', regexp_replace(url, '#.*$', '') || '#s' FROM x UNION ALL SELECT page_id, 'HTTPS://o.example.org/', 'HTTPS://o.example.org/' FROM x
UNION ALL SELECT page_id, '../../../up', root || '/up' FROM x UNION ALL SELECT page_id, '/a/./b/../c/', root || '/a/c/' FROM x""")
def resolve(t: Inputs):
    refs = ["/a/c?x=../y", "img/../z.png", "//cdn.example.org/l.js", "?q=1", "#s", "HTTPS://o.example.org/", "../../../up", "/a/./b/../c/"]
    d = t.pages.select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in refs])).alias("ref"))
    return d.select("page_id", "ref", U.resolve(F.col("url"), F.col("ref")).alias("resolved"))


@query("sca_13_url_parts", """
WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(list_filter(string_split(p, '/'), lambda s: s <> ''))::INT AS depth, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, '&')) END::INT AS params,
  regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1) AS extension, CASE WHEN starts_with(url, 'https') THEN 'web_https' ELSE 'web_http' END AS kind FROM x""")
def url_parts(t: Inputs):
    u = F.col("url")
    return t.pages.select("page_id", U.host(u).alias("host"), U.path_depth(u).alias("depth"), U.params_count(u).alias("params"), U.extension(u).alias("extension"), U.url_kind(u).alias("kind"))


@query("sca_14_hierarchy", """
WITH x AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '/x/y', '/'), lambda s: s <> '') AS parts FROM pages),
y AS (SELECT *, unnest(range(1, len(parts))) AS i FROM x) SELECT page_id, root || '/' || array_to_string(parts[1:i], '/') AS ancestor FROM y""")
def hierarchy(t: Inputs):
    u = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/x/y"))
    return t.pages.select("page_id", F.explode(U.ancestors(u)).alias("ancestor"))


@query("sca_15_digests", """
SELECT doc_id, sha256(text) AS sha, substr(md5(text), 1, 12) AS id12, substr(md5(lang || ':' || source), 1, 16) AS id16, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS fields_sha FROM documents""")
def digests(t: Inputs):
    return t.spread("documents").select("doc_id", D.sha256_hex(F.col("text")).alias("sha"), D.short_md5(F.col("text"), 12).alias("id12"),
                              D.short_md5(F.concat_ws(":", "lang", "source"), 16).alias("id16"),
                              D.sha256_hex(D.sorted_json(source=F.col("source"), lang=F.col("lang"))).alias("fields_sha"))


@query("sca_16_cache_keys", """
WITH q AS (SELECT doc_id, lower(trim(source || ' ' || lang || ' Query')) AS q FROM documents)
SELECT doc_id, 'search:' || regexp_replace(substr(q, 1, 20), '[^a-z0-9]+', '-', 'g') || ':' || substr(sha256('{"engines":["bing","google"],"language":"en","max_results":10,"query":"' || q || '"}'), 1, 16) AS cache_key FROM q""")
def cache_keys(t: Inputs):
    q = F.concat_ws(" ", "source", "lang", F.lit("Query "))
    return t.spread("documents").select("doc_id", D.search_cache_key(q, F.array(F.lit("google"), F.lit("bing")), F.lit("en"), F.lit(10)).alias("cache_key"))


def _pad_sql(byte: int) -> str:
    return f"unhex(array_to_string(list_transform(range(0, 64), lambda i: format('{{:02x}}', CAST(xor(CAST('0x' || substr(k, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), {byte}) AS BIGINT))), ''))"


@query("sca_17_hmac", f"""
WITH d AS (SELECT doc_id, text, 'secret-' || source || repeat('k', CAST(doc_id % 90 AS INTEGER)) AS key FROM documents),
p AS (SELECT doc_id, text, rpad(CASE WHEN length(key) > 64 THEN sha256(key) ELSE lower(hex(encode(key))) END, 128, '0') AS k FROM d)
SELECT doc_id, sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(text)))) AS signature, true AS valid, false AS tampered_valid FROM p""")
def hmac(t: Inputs):
    """Signature and verification of every document."""
    key = F.concat(F.lit("secret-"), "source", F.repeat(F.lit("k"), F.col("doc_id").cast("int") % 90))
    s = D.hmac_sha256_hex(F.col("text"), key)
    d = t.spread("documents").select("doc_id", "text", key.alias("key"), s.alias("signature"))
    return d.select("doc_id", "signature", D.signature_ok(F.col("text"), F.col("key"), F.concat(F.lit("sha256="), "signature")).alias("valid"),
                    D.signature_ok(F.concat("text", F.lit("!")), F.col("key"), F.col("signature")).alias("tampered_valid"))


@query("sca_18_rate_string", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 100 ELSE o_custkey END AS amount, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 60 WHEN '3-MEDIUM' THEN 3600 WHEN '4-NOT SPECIFIED' THEN 86400 ELSE 3600 END AS seconds FROM orders""")
def rate_string(t: Inputs):
    unit = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "/second", "2-HIGH", "/minute", "3-MEDIUM", "/hour", "4-NOT SPECIFIED", "/day", "5-LOW", "-broken")]), F.col("o_orderpriority"))
    amount, seconds = DT.rate_limit(F.concat(F.col("o_custkey").cast("string"), unit))
    return t.orders.select("o_orderkey", amount.cast("long").alias("amount"), seconds.alias("seconds"))


@query("sca_19_dates", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', o_orderdate) + INTERVAL 30 DAY, '%Y-%m-%d') AS period_end,
  strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS next_midnight, date_diff('day', TIMESTAMP '1998-01-01', o_orderdate)::INT AS days_remaining,
  strftime(o_orderdate + to_seconds(30 * (2 ** (o_custkey % 5))::BIGINT), '%Y-%m-%d %H:%M:%S') AS retry_at FROM orders""")
def dates(t: Inputs):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(DT.month_start(d), "yyyy-MM-dd").alias("month_start"), F.date_format(DT.period_end(d), "yyyy-MM-dd").alias("period_end"),
                           F.date_format(DT.next_midnight(d), "yyyy-MM-dd HH:mm").alias("next_midnight"), DT.days_remaining(d, F.lit("1998-01-01").cast("timestamp_ntz")).alias("days_remaining"),
                           F.date_format(DT.retry_at(d, 30, F.col("o_custkey") % 5 + 1), "yyyy-MM-dd HH:mm:ss").alias("retry_at"))


@query("sca_20_attribute_values", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS numeric_value, l_linestatus = 'F' AS flag, l_returnflag || '+' || l_linestatus AS listed, upper('ab' || l_returnflag) AS upper_value, l_partkey::VARCHAR AS picked, l_partkey > 99 AS valid FROM lineitem""")
def attribute_values(t: Inputs):
    from ..functions import attributes as AT
    price = F.concat(F.lit("costs $"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(" net"))
    flag = F.when(F.col("l_linestatus") == "F", "Checked").otherwise("no")
    lst = F.concat("l_returnflag", F.lit(" ;| "), "l_linestatus", F.lit(","))
    pick = F.concat(F.lit("id="), F.col("l_partkey").cast("string"), F.lit("x"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(AT.numeric(price), 2).alias("numeric_value"), AT.boolean(flag).alias("flag"), F.array_join(AT.as_list(lst), "+").alias("listed"),
                             AT.transform(F.concat(F.lit("ab"), "l_returnflag"), "uppercase").alias("upper_value"), AT.transform(pick, r"regex:id=(\d+)").alias("picked"),
                             AT.valid(pick, r"=\d{3,}").alias("valid"))


@query("sca_21_json_in_text", """
SELECT c_custkey, c_mktsegment AS verdict, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 100 END, 0.5) AS confidence, c_nationkey + 1 AS second_item FROM customer""")
def json_in_text(t: Inputs):
    reply = F.concat(F.lit("Here you are:\n"), F.to_json(F.struct(F.col("c_mktsegment").alias("verdict"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") / 100).alias("confidence"))), F.lit("\nDone."))
    lst = F.concat(F.lit("list "), F.to_json(F.array("c_nationkey", F.col("c_nationkey") + 1)), F.lit(" end"))
    j = JW.json_in_text(reply, "verdict string, confidence double")
    return t.customer.select("c_custkey", j["verdict"].alias("verdict"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"), JW.json_in_text(lst, "array<int>", array=True)[1].alias("second_item"))


AGENTS = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{v}.0 Safari/537.36",
          "Mozilla/5.0 (X11; Linux x86_64; rv:{v}.0) Gecko/20100101 Firefox/{v}.0",
          "Mozilla/5.0 (Macintosh; Intel Mac OS X 13_1) AppleWebKit/605.1 (KHTML, like Gecko) Version/{v}.0 Safari/605.1",
          "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1 (KHTML, like Gecko) Version/{v}.0 Mobile Safari/604.1", "curl/{v}.0")


@query("sca_22_user_agent", """
SELECT event_id, ['Chrome','Firefox','Safari','Safari','Unknown'][(user_id % 5 + 1)::INT] AS browser, CASE WHEN user_id % 5 = 4 THEN '0.0' ELSE (90 + user_id % 30) || '.0' END AS version,
  ['Desktop','Desktop','Desktop','Desktop','Unknown'][(user_id % 5 + 1)::INT] AS platform, ['Windows','Linux','Mac OS','iOS','Unknown'][(user_id % 5 + 1)::INT] AS os, ['WebKit','Gecko','WebKit','WebKit','Unknown'][(user_id % 5 + 1)::INT] AS engine FROM events""")
def user_agent(t: Inputs):
    ua = F.replace(F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("user_id") % 5 + 1).cast("int")), F.lit("{v}"), (90 + F.col("user_id") % 30).cast("string"))
    d = t.events.select("event_id", C.parse_agent(ua).alias("a"))
    return d.select("event_id", "a.browser", "a.version", "a.platform", "a.os", "a.engine")


@query("sca_23_context", """
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents),
c AS (SELECT source, string_agg('[Source ' || rk || ']' || chr(10) || 'Title: ' || source || chr(10) || 'URL: https://example.org/' || doc_id || chr(10) || 'Content: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rk) AS c FROM r WHERE rk <= 5 GROUP BY 1)
SELECT source, length(c) AS n, md5(c) AS context_md5 FROM c""")
def context(t: Inputs):
    """Context of the five best documents of each source."""
    d = t.spread("documents").select("source", "doc_id", "text", "n_chars")
    top = top_per_key(d, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5)
    c = P.context(top, ["source"], F.col("rank"), F.col("source"), F.concat(F.lit("https://example.org/"), "doc_id"), F.col("text"))
    return c.select("source", F.length("context").cast("long").alias("n"), F.md5("context").alias("context_md5"))


@query("sca_24_query_expansion", """
WITH tpl AS (SELECT unnest(range(0, 12)) AS i) SELECT DISTINCT n_name AS topic, i::INT AS i,
  [n_name, 'what is ' || n_name, 'history of ' || n_name, n_name || ' 2024 latest', n_name || ' how it works', n_name || ' practical examples', n_name || ' vs alternatives', n_name || ' expert analysis', 'future of ' || n_name,
   n_name || ' case studies', n_name || ' best practices', n_name || ' detailed analysis'][i + 1] AS query FROM nation, tpl""")
def query_expansion(t: Inputs):
    return t.nation.select(F.col("n_name").alias("topic"), F.posexplode(P.research_queries(F.col("n_name"), 12)).alias("i", "query"))
