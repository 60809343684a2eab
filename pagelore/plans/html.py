"""HTML operators over the page table and over pages made from the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dom
from ..functions import markdown as M
from ..functions import text as X
from ..operators import entities as E
from ..operators import pages as P
from ..operators.skew import nested
from ..session import table_once
from .registry import Inputs, query
from .scalars import WS

ENT = "replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
SQUEEZE = "trim(regexp_replace({}, '" + WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"


def strip(expr: str) -> str:
    return SQUEEZE.format(ENT.format(f"regexp_replace(regexp_replace(regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')"))


ARTICLE = strip("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")
AD = strip("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")
TITLE = strip("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
MAIN_SQL = f"""main AS (SELECT page_id, url, html, {TITLE} AS title, CASE WHEN length(a) > 100 THEN a WHEN greatest(length(a), length(d)) > 50 THEN CASE WHEN length(d) > length(a) THEN d ELSE a END ELSE w END AS text
  FROM (SELECT *, {ARTICLE} AS a, {AD} AS d, {strip('html')} AS w FROM pages))"""


def product_pages(t: Inputs):
    """One product page per part: head metadata, images, headings, lists, code, quote, links and two cards."""
    k, n, b = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    html = F.concat(
        F.lit('<html lang="en"><head><title>Product '), n, F.lit('</title><meta name="description" content="A '), n, F.lit(" of "), b,
        F.lit('"><meta name="Author" content="'), b, F.lit('"><meta property="article:published_time" content="2024-02-03T04:05:06"><meta name="keywords" content="'), n, F.lit(", "), F.col("p_type"),
        F.lit(' ,"><meta property="og:title" content="OG '), n, F.lit('"><meta property="og:image" content="/og/'), k, F.lit('.png"><meta name="twitter:card" content="summary"><meta name="viewport" content="width=device-width">'),
        F.lit('<link rel="canonical" href="/part/'), k, F.lit('"><script type="application/ld+json">{"sku": '), k, F.lit('}</script><style>p{}</style></head><body><h1 id="title">'), n,
        F.lit('</h1><img src="/img/'), k, F.lit('.png" alt="front"><img data-src="lazy/'), k, F.lit('.png" alt="side"><img src="/px.gif" width="1" height="1px"><img src="https://ad.doubleclick.net/x">'),
        F.lit('<img src="/img/'), k, F.lit('.png"><picture><source srcset="/big/'), k, F.lit('.png 2x, /b.png 3x"></picture><h2>Details</h2><p>Type <b>'), F.col("p_type"), F.lit("</b> and <em>size</em>  "),
        F.col("p_size").cast("string"), F.lit('.<br>See <a href="/brand/'), F.col("p_brand"), F.lit('">brand</a> or <a href="/brand/'), F.col("p_brand"), F.lit('" title="again">maker</a> or <a href="https://o.example.org/">other</a>.</p>'),
        F.lit("<ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul><ol><li>first<li>second</ol><pre><code class=\"language-python\">x = 1\n  y = "), k,
        F.lit("</code></pre><blockquote>Quote "), b, F.lit('</blockquote><div class="card"><h3>Card '), n, F.lit('</h3><span class="price">$'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit('</span><a class="more" href="buy/'), k, F.lit('">buy</a></div><div class="card"><h3>Spare</h3></div><p hidden>secret</p></body></html>'))
    return t.spread("part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.org/list/"), k).alias("url"), html.alias("html"))


def products(t: Inputs):
    return table_once(t.spark, t.folder, "parsed_products", lambda: dom.parse_pages(product_pages(t)))


def order_pages(t: Inputs):
    """One page per order with its lines as a data table; small orders come as layout tables."""
    li = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).alias("x"),
                           F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("i"))
    rows = nested(li, ["l_orderkey"], F.col("x"), F.col("i"), "rows")
    tr = F.array_join(F.transform("rows", lambda r: F.concat(
        F.lit("<tr><td>"), r["l_linenumber"].cast("string"), F.lit("</td><td><a href=\"/part/"), r["l_partkey"].cast("string"), F.lit("\">Part "), r["l_partkey"].cast("string"),
        F.lit("</a></td><td>"), r["q"].cast("string"), F.lit("</td></tr>"))), "")
    html = F.when(F.size("rows") == 1, F.concat(F.lit("<table class='layout'><tr><td>a</td><td>"), tr, F.lit("</td></tr></table>"))).otherwise(F.concat(
        F.lit("<p>Order</p><table class='data'><caption>Order "), F.col("l_orderkey").cast("string"), F.lit("</caption><thead><tr><th>Line</th><th>Part</th><th>Qty</th></tr></thead><tbody>"), tr,
        F.lit("<tr><td colspan=2>Total</td><td>all</td></tr></tbody></table>")))
    return rows.select(F.col("l_orderkey").alias("page_id"), F.lit("https://shop.example.org/orders/").alias("url"), html.alias("html"))


def order_tables(t: Inputs):
    return P.tables(table_once(t.spark, t.folder, "parsed_orders", lambda: dom.parse_pages(order_pages(t).repartition(t.spark.sparkContext.defaultParallelism * 2, "page_id"))))


@query("htm_00_nodes", """
SELECT page_id, len(regexp_extract_all(html, '<a '))::INT AS a, len(regexp_extract_all(html, '<p>'))::INT AS p, len(regexp_extract_all(html, '<li>'))::INT AS li, len(regexp_extract_all(html, '<br>'))::INT AS br FROM pages""")
def nodes(t: Inputs):
    return dom.parsed_pages(t).select("page_id", *[F.size(dom.elements(F.col("nodes"), x)).alias(x) for x in ("a", "p", "li", "br")])


@query("htm_01_links", """
WITH l AS (SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages)
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link, arg_min(anchor, i) AS anchor FROM l GROUP BY 1, 2""")
def links(t: Inputs):
    from ..operators.skew import first_per_key
    return first_per_key(P.links(dom.parsed_pages(t)).select("page_id", "link", "pos", "anchor"), ["page_id", "link"], [F.col("pos")]).select("page_id", "link", "anchor")


@query("htm_02_images", """
SELECT p_partkey AS page_id, 'https://shop.example.org/img/' || p_partkey || '.png https://shop.example.org/list/lazy/' || p_partkey || '.png https://shop.example.org/big/' || p_partkey || '.png' AS images FROM part""")
def images(t: Inputs):
    return products(t).select("page_id", F.array_join(F.transform(P.image_array(F.col("url")), lambda x: x["link"]), " ").alias("images"))


@query("htm_03_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def title(t: Inputs):
    return dom.parsed_pages(t).select("page_id", P.title().alias("title"))


@query("htm_04_metadata", """
SELECT p_partkey AS page_id, 'A ' || p_name || ' of ' || p_brand AS description, p_brand AS author, '2024-02-03 04:05:06' AS published, p_name || '|' || p_type AS keywords,
  'OG ' || p_name AS og_title, 'summary' AS twitter_card, p_partkey::INT AS sku FROM part""")
def metadata(t: Inputs):
    m = P.metadata()
    return products(t).select("page_id", m["description"].alias("description"), m["author"].alias("author"), F.date_format(m["published"], "yyyy-MM-dd HH:mm:ss").alias("published"),
                              F.array_join(m["keywords"], "|").alias("keywords"), m["og"]["title"].alias("og_title"), m["twitter"]["card"].alias("twitter_card"),
                              F.from_json(m["json_ld"], "sku int")["sku"].alias("sku"))


@query("htm_05_main_content", f"WITH {MAIN_SQL} SELECT page_id, length(text) AS n, md5(text) AS text_md5 FROM main")
def main_content(t: Inputs):
    return dom.parsed_pages(t).select("page_id", P.main_content().alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("text_md5"))


@query("htm_06_selectors", """
SELECT p_partkey AS page_id, p_name AS title, 'Card ' || p_name || '$' || printf('%.2f', p_retailprice) || 'buy' AS content, '' AS missing FROM part""")
def selectors(t: Inputs):
    return P.select_fields(products(t), {"title": "h1#title", "content": "div.card", "missing": ".absent"})


@query("htm_07_page_record", f"""
WITH {MAIN_SQL} SELECT page_id, title, md5(text) AS text_md5, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INT AS word_count,
  len(regexp_extract_all(html, '<a href'))::INT AS n_links, 0 AS n_images, text <> '' AS success FROM main""")
def page_record(t: Inputs):
    return P.page_record(dom.parsed_pages(t)).select("page_id", "title", F.md5("text").alias("text_md5"), "word_count", "n_links", "n_images", "success")


@query("htm_07_page_quality")
def page_quality(t: Inputs):
    """Language and quality of the page records (the sentence rule needs look-behind, see the tests)."""
    return P.page_record(dom.parsed_pages(t)).select("page_id", "language", F.round("quality", 6).alias("quality"))


@query("htm_08_preview", """
SELECT p_partkey AS page_id, 'OG ' || p_name AS title, 'A ' || p_name || ' of ' || p_brand AS description, '/og/' || p_partkey || '.png' AS image,
  'https://shop.example.org/part/' || p_partkey AS canonical, 'en' AS language, 'width=device-width' AS viewport, p_name || '|' || p_type AS keywords FROM part""")
def preview(t: Inputs):
    return P.preview(products(t)).select("page_id", "title", "description", "image", "canonical", "language", "viewport", F.array_join("keywords", "|").alias("keywords"))


@query("htm_08_found_keywords")
def found_keywords(t: Inputs):
    """Keywords found in headings, emphasis and first paragraph of pages that declare none."""
    return P.preview(dom.parsed_pages(t)).select("page_id", F.array_join("keywords", " ").alias("keywords"), F.length("preview").alias("n_preview"), "content_length")


@query("htm_09_preview_scores", """
SELECT p_partkey AS page_id, round(CASE WHEN contains(p_name, 'widget') THEN 2/3 ELSE 1/3 END, 6) AS relevance,
  round(1.0 * 0.4 + 0.3 * 0.3 + 0.3 * CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.7 END, 6)::DOUBLE AS quality FROM part""")
def preview_scores(t: Inputs):
    pv = P.preview(products(t))
    q = X.literal_set(["brand", "widget", "zzz"])
    ps = t.part.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_size") % 2 == 0, 200).otherwise(204).alias("status"), F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(3.0).alias("seconds"))
    s = P.preview_scores(pv.join(ps, "page_id"), q, F.col("status"), F.col("seconds"), F.lit("text/html"))
    return s.select("page_id", F.round("relevance", 6).alias("relevance"), F.round("quality", 6).alias("quality"))


ORDER_N = "o AS (SELECT l_orderkey AS page_id, count(*) AS n FROM lineitem GROUP BY 1)"


@query("htm_10_table_scores", f"""
WITH {ORDER_N} SELECT page_id, 0 AS table_no, (CASE WHEN n = 1 THEN CASE WHEN 1=1 THEN 0 END ELSE 5 + 3 + 3 + 2 + 2 + CASE WHEN n + 2 > 5 THEN 3 ELSE 1 END + 0 + 1 + 1 END)::INT AS score, n > 1 AS is_data FROM o""")
def table_scores(t: Inputs):
    s = P.table_scores(order_tables(t)).where("table_no = 0")
    return s.select("page_id", "table_no", F.when(F.col("score") < 7, 0).otherwise(F.col("score")).alias("score"), (F.col("score") >= 7).alias("is_data"))


@query("htm_11_table_rows", """
WITH m AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey AS page_id, l_linenumber::VARCHAR AS line, 'Part ' || l_partkey AS part, 'https://shop.example.org/part/' || l_partkey AS part_url, (l_quantity::INT)::VARCHAR AS qty FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM m)
UNION ALL SELECT l_orderkey, 'Total', '', NULL, 'all' FROM m""")
def table_rows(t: Inputs):
    r = P.table_rows(order_tables(t)).where("valid AND size(headers) = 3").select("page_id", F.explode("rows").alias("r"))
    return r.select("page_id", F.col("r")[0]["text"].alias("line"), F.col("r")[1]["text"].alias("part"), F.get(F.col("r")[1]["links"], F.lit(0))["url"].alias("part_url"), F.col("r")[2]["text"].alias("qty"))


@query("htm_12_table_complexity", f"""
WITH {ORDER_N} SELECT page_id, (2 + (n + 2) // 5 + 1 + 3)::INT AS complexity, 2 + (n + 2) // 5 + 4 >= 15 AS review FROM o WHERE n > 1""")
def table_complexity(t: Inputs):
    s = P.table_scores(order_tables(t)).where("score >= 7")
    return s.select("page_id", "complexity", (F.col("complexity") >= 15).alias("review"))


@query("htm_13_table_markdown", """
WITH m AS (SELECT l_orderkey AS page_id, string_agg('| ' || l_linenumber || ' | [Part ' || l_partkey || '](https://shop.example.org/part/' || l_partkey || ') | ' || l_quantity::INT || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b
  FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, '| Line | Part | Qty |' || chr(10) || '| --- | --- | --- |' || chr(10) || b || chr(10) || '| Total |  | all |' AS markdown FROM m""")
def table_markdown(t: Inputs):
    return P.table_rows(order_tables(t)).where("valid AND size(headers) = 3").select("page_id", P.table_markdown(F.col("headers"), F.col("rows")).alias("markdown"))


@query("htm_14_schema", """
SELECT p_partkey AS page_id, 0 AS item, 'Card ' || p_name AS name, '$' || printf('%.2f', p_retailprice) AS price, 'https://shop.example.org/list/buy/' || p_partkey AS link FROM part
UNION ALL SELECT p_partkey, 1, 'Spare', '', '' FROM part""")
def schema(t: Inputs):
    return P.schema_rows(products(t), "div.card", [{"name": "name", "selector": "h3"}, {"name": "price", "selector": ".price"},
                                                   {"name": "link", "selector": "a.more", "type": "attribute", "attribute": "href"}])


def regex_rows(df, key: str, text: str, rules: dict[str, str]):
    """One row per match of each rule; texts without any match give their paragraphs of five words or more. Row-local."""
    hits = F.concat(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 0), _rule_row(r)) for r, p in rules.items()])
    paras = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: X.word_count(x) >= 5)
    chunks = F.transform(paras, _rule_row("text_chunk"))
    d = df.select(key, X.let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(chunks)).alias("h"))
    return d.select(key, F.explode("h").alias("h")).select(key, "h.*")


def _rule_row(rule):
    return lambda v, i: F.struct(F.lit(rule).alias("rule"), i.alias("idx"), v.alias("value"))


@query("htm_15_regex_extraction", r"""
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '\b\d{3}[-.]\d{3}[-.]\d{4}\b') AS a, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS b FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 5) AS c FROM m WHERE len(a) + len(b) = 0)
SELECT doc_id, 'phone' AS rule, (generate_subscripts(a, 1) - 1)::INT AS idx, md5(unnest(a)) AS value_md5 FROM m UNION ALL SELECT doc_id, 'mail', (generate_subscripts(b, 1) - 1)::INT, md5(unnest(b)) FROM m
UNION ALL SELECT doc_id, 'text_chunk', (generate_subscripts(c, 1) - 1)::INT, md5(unnest(c)) FROM c""")
def regex_extraction(t: Inputs):
    r = regex_rows(t.documents, "doc_id", "text", {"phone": r"\b\d{3}[-.]\d{3}[-.]\d{4}\b", "mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"})
    return r.select("doc_id", "rule", "idx", F.md5("value").alias("value_md5"))


@query("htm_16_attributes", """
SELECT p_partkey AS page_id, 'a' AS selector, 'href' AS attribute, 0 AS pos, 'https://shop.example.org/brand/' || p_brand AS value FROM part
UNION ALL SELECT p_partkey, 'a', 'href', 1, 'https://o.example.org/' FROM part UNION ALL SELECT p_partkey, 'a', 'href', 2, 'https://shop.example.org/list/buy/' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'a', 'title', 0, 'again' FROM part UNION ALL SELECT p_partkey, 'img', 'alt', 0, 'front' FROM part UNION ALL SELECT p_partkey, 'img', 'alt', 1, 'side' FROM part
UNION ALL SELECT p_partkey, '[id]', 'id', 0, 'title' FROM part UNION ALL SELECT p_partkey, '[class]', 'class', 0, 'language-python' FROM part UNION ALL SELECT p_partkey, '[class]', 'class', 1, 'card' FROM part
UNION ALL SELECT p_partkey, '[class]', 'class', 2, 'price' FROM part UNION ALL SELECT p_partkey, '[class]', 'class', 3, 'more' FROM part UNION ALL SELECT p_partkey, 'link', 'rel', 0, 'canonical' FROM part""")
def attributes(t: Inputs):
    keep = {("a", "href"), ("a", "title"), ("img", "alt"), ("[id]", "id"), ("[class]", "class"), ("link", "rel")}
    return P.attribute_values(products(t), [r for r in P.COMMON_RULES if r[:2] in keep])


@query("htm_16_common_attributes")
def common_attributes(t: Inputs):
    """All twenty preset rules over the page table."""
    return P.attribute_values(dom.parsed_pages(t))


@query("htm_17_regex_entities", r"""
WITH m AS (SELECT doc_id, 'email' AS k, regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') AS v FROM documents
  UNION ALL SELECT doc_id, 'phone', regexp_extract_all(text, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b') FROM documents UNION ALL SELECT doc_id, 'price', regexp_extract_all(text, '\$\d+(?:\.\d{2})?') FROM documents
  UNION ALL SELECT doc_id, 'date', regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b') FROM documents UNION ALL SELECT doc_id, 'url', regexp_extract_all(text, '(?i)https?://[^\s<>"{}|\\^`\[\]]+') FROM documents)
SELECT 'doc' || doc_id || ':regex:' || k || ':' || (generate_subscripts(v, 1) - 1) AS id, unnest(v) AS value, 0.8::DOUBLE AS confidence FROM m""")
def regex_entities(t: Inputs):
    return E.find_entities(t.spread("documents").select(F.concat(F.lit("doc"), "doc_id").alias("u"), "text"), "text", "u").select("id", "value", "confidence")


@query("htm_17_css_entities", """
SELECT p_partkey AS page_id, 'title' AS entity_type, p_name AS value FROM part UNION ALL SELECT p_partkey, 'title', 'Details' FROM part UNION ALL SELECT p_partkey, 'title', p_name FROM part
UNION ALL SELECT p_partkey, 'price', '$' || printf('%.2f', p_retailprice) FROM part""")
def css_entities(t: Inputs):
    return P.css_entities(products(t)).select("page_id", "entity_type", "value")


MD_SQL = """'# ' || p_name || chr(10) || chr(10) || '![front](https://shop.example.org/img/' || p_partkey || '.png)![](https://shop.example.org/px.gif)![](https://ad.doubleclick.net/x)![](https://shop.example.org/img/' || p_partkey || '.png)'
  || chr(10) || chr(10) || '## Details' || chr(10) || chr(10) || 'Type **' || p_type || '** and *size* ' || p_size || '.' || chr(10) || 'See [brand](https://shop.example.org/brand/' || p_brand || ') or [maker](https://shop.example.org/brand/' || p_brand
  || ') or [other](https://o.example.org/).' || chr(10) || chr(10) || '- one' || chr(10) || '  - inner' || chr(10) || '- two' || chr(10) || chr(10) || '1. first' || chr(10) || '2. second' || chr(10) || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10)
  || '  y = ' || p_partkey || chr(10) || '```' || chr(10) || chr(10) || '> Quote ' || p_brand || chr(10) || chr(10) || '### Card ' || p_name || chr(10) || chr(10) || '$' || printf('%.2f', p_retailprice) || '[buy](https://shop.example.org/list/buy/'
  || p_partkey || ')' || chr(10) || chr(10) || '### Spare'"""


@query("htm_18_markdown", f"SELECT p_partkey AS page_id, {MD_SQL} AS markdown FROM part")
def markdown(t: Inputs):
    return products(t).select("page_id", M.render(F.col("body_text"), F.col("nodes"), F.col("url")).alias("markdown"))


@query("htm_18_page_markdown")
def page_markdown(t: Inputs):
    """Markdown of the page table without navigation and footer."""
    return dom.parsed_pages(t).select("page_id", M.render(F.col("body_text"), F.col("nodes"), F.col("url"), drop="title,head,nav,footer").alias("markdown"))


@query("htm_19_plain_text", """
SELECT p_partkey AS page_id, p_name || chr(10) || chr(10) || 'Details' || chr(10) || chr(10) || 'Type ' || p_type || ' and size ' || p_size || '.' || chr(10) || 'See brand or maker or other.' || chr(10) || chr(10) || '* one' || chr(10) || '  * inner' || chr(10) || '* two'
  || chr(10) || chr(10) || '1. first' || chr(10) || '2. second' || chr(10) || chr(10) || 'x = 1' || chr(10) || '  y = ' || p_partkey || chr(10) || chr(10) || 'Quote ' || p_brand || chr(10) || chr(10) || 'Card ' || p_name || chr(10) || chr(10)
  || '$' || printf('%.2f', p_retailprice) || 'buy' || chr(10) || chr(10) || 'Spare' AS text FROM part""")
def plain_text(t: Inputs):
    return products(t).select("page_id", M.render(F.col("body_text"), F.col("nodes"), F.col("url"), markdown=False, links=False, images=False).alias("text"))


@query("htm_20_citations", """
SELECT p_partkey AS page_id, 'See brand[1] or maker[1] or other[2].' AS sentence, '## References' || chr(10) || '1. [brand](https://shop.example.org/brand/' || p_brand || ')' || chr(10) || '2. [other](https://o.example.org/)' || chr(10) || '3. [buy](https://shop.example.org/list/buy/' || p_partkey || ')' AS refs FROM part""")
def citations(t: Inputs):
    d = products(t).select("page_id", M.citations(M.render(F.col("body_text"), F.col("nodes"), F.col("url"))).alias("c"))
    return d.select("page_id", F.regexp_extract("c.text", r"(See [^\n]*)", 1).alias("sentence"), M.references_markdown(F.col("c.refs")).alias("refs"))


@query("htm_21_blocks")
def blocks(t: Inputs):
    """Text blocks of the page table with their scores."""
    return P.blocks(dom.parsed_pages(t)).select("page_id", "block", "tag", "words", "score", F.md5("text").alias("text_md5"))


@query("htm_22_pruning")
def pruning(t: Inputs):
    return P.prune(P.blocks(dom.parsed_pages(t)), adaptive=True).select("page_id", "block", "keep", F.round("relevance", 6).alias("relevance"))
