"""Page-table operators on parsed pages (`body_text`, `nodes`): all row-local column work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as AT
from ..functions import dom
from ..functions import text as X
from ..functions import urls as U
from ..functions.checks import tracking_pixel
from ..functions.scoring import lookup, plus
from ..functions.text import let


def _n() -> Column:
    return F.col("nodes")


def _b() -> Column:
    return F.col("body_text")


# Content selectors in order of trust, preview selectors, block tags and their scores.
CONTENT_SELECTORS = ("main", "article", "[role=main]", "#content", ".content", "#main", ".main", "div.post",
                     "div.entry-content", "div.article-body", "div.story-body")
PREVIEW_SELECTORS = ("main", "article", ".content", ".main-content", ".post-content", ".entry-content", "#content")
BLOCK_TAGS = ("article main section div ul ol li dl dt dd p span blockquote pre code h1 h2 h3 h4 h5 h6 table thead tbody "
              "tr td th figure figcaption details summary em strong b i mark small time address cite q").split()
DROPPED_TAGS = "script style noscript nav footer header aside form button input".split()
TAG_SCORES = {"h1": 10, "h2": 8, "h3": 6, "h4": 4, "h5": 2, "h6": 1, "article": 8, "main": 8, "section": 6, "p": 3, "div": 1,
              "span": 1, "li": 2, "td": 2, "th": 3, "strong": 2, "em": 1, "b": 2, "i": 1}
CONTENT_HINTS = "content article main body text post entry story news blog".split()
KEYWORD_STOP = ("the a an and or but in on at to for of with by this that these those is are was were will would could "
                "should may might can have has had do does did get got make made take took").split()


def text_of(n: Column) -> Column:
    return dom.text_of(_b(), n)


def clean_of(n: Column) -> Column:
    return X.squeeze(text_of(n))


def links(df: DataFrame, base: str = "url") -> DataFrame:
    """(page columns, pos, link, anchor): absolute address; anchor text, else title, else the reference."""
    keep = [c for c in df.columns if c not in ("nodes", "body_text")]
    a = df.select(*keep, "body_text", F.posexplode(dom.elements(_n(), "a[href]")).alias("pos", "n"))
    at = F.col("n.attrs")
    text = F.coalesce(F.nullif(clean_of(F.col("n")), F.lit("")), F.nullif(F.trim(at["title"]), F.lit("")), at["href"])
    return a.select(*keep, "pos", U.resolve(F.col(base), at["href"]).alias("link"), text.alias("anchor"))


def distinct_links(arr: Column) -> Column:
    """First occurrence per address of an array of (link, ...) structs."""
    return let(arr, lambda a: let(F.transform(a, lambda x: x["link"]), lambda u: F.filter(a, lambda x, i: F.array_position(u, x["link"]) == i + 1)))


def image_array(base: Column, limit: int | None = None) -> Column:
    """Image structs of a page: lazy sources and picture sources resolved, trackers and repeats left out; all of them,
    or the first `limit`."""
    els = F.filter(_n(), lambda n: n["tag"].isin("img", "source"))

    def one(n):
        a = n["attrs"]
        src = F.coalesce(a["src"], a["data-src"], a["data-lazy-src"], F.regexp_extract(a["srcset"], r"^\s*(\S+)", 1))
        return F.struct(U.resolve(base, src).alias("link"), F.coalesce(a["alt"], F.lit("")).alias("alt"),
                        tracking_pixel(F.coalesce(src, F.lit("")), a["width"], a["height"]).alias("pixel"), src.isNull().alias("none"))

    found = distinct_links(F.filter(F.transform(els, one), lambda x: ~x["pixel"] & ~x["none"]))
    return F.slice(found, 1, limit) if limit else found


def title() -> Column:
    t = lambda sel: F.nullif(clean_of(dom.first(_n(), sel)), F.lit(""))
    return F.coalesce(t("title"), dom.meta(_n(), "property", "og:title"), t("h1"), F.lit("Untitled"))


def prefixed_map(attr: str, prefix: str) -> Column:
    """og:* or twitter:* properties as map; the last value of a repeated name wins."""
    hits = F.filter(_n(), lambda n: (n["tag"] == "meta") & F.coalesce(F.lower(n["attrs"][attr]).startswith(prefix), F.lit(False)))
    kv = F.transform(hits, lambda n: F.struct(F.substring(F.lower(n["attrs"][attr]), F.lit(len(prefix) + 1), F.length(n["attrs"][attr])).alias("k"),
                                              F.coalesce(n["attrs"]["content"], F.lit("")).alias("v")))
    return let(kv, lambda a: let(F.array_distinct(F.transform(a, lambda x: x["k"])), lambda ks: F.map_from_arrays(
        ks, F.transform(ks, lambda k: F.element_at(F.filter(a, lambda x: x["k"] == k), -1)["v"]))))


def metadata() -> dict[str, Column]:
    ld = F.get(F.filter(_n(), lambda n: (n["tag"] == "script") & (n["attrs"]["type"] == "application/ld+json")), F.lit(0))["raw"]
    kw = dom.meta(_n(), "name", "keywords")
    return {"description": F.coalesce(dom.meta(_n(), "name", "description"), dom.meta(_n(), "property", "og:description")),
            "author": dom.meta(_n(), "name", "author"), "published": F.try_to_timestamp(dom.meta(_n(), "property", "article:published_time")),
            "keywords": F.filter(F.transform(F.split(kw, ","), lambda x: F.trim(x)), lambda x: x != ""),
            "og": prefixed_map("property", "og:"), "twitter": prefixed_map("name", "twitter:"), "json_ld": F.trim(ld)}


def main_content() -> Column:
    """First trusted container with more than 100 characters, else the longest block over 50 (of equal ones an article, then the first), else everything."""
    picks = [let(clean_of(dom.first(_n(), s)), lambda x: F.when(F.length(x) > 100, x)) for s in CONTENT_SELECTORS]
    blocks = F.transform(dom.elements(_n(), "div,section,article"), lambda n, i: let(clean_of(n), lambda x: F.struct(
        F.length(x).alias("n"), (n["tag"] == "article").alias("a"), (-i).alias("o"), x.alias("x"))))
    longest = F.array_max(F.filter(blocks, lambda x: x["n"] > 50))["x"]
    return F.coalesce(*picks, longest, X.squeeze(_b()))


def page_record(df: DataFrame) -> DataFrame:
    """Full page record; a page without any text is a failed row."""
    d = df.withColumns({"title": title(), "text": main_content()})
    n_links = F.size(F.filter(dom.elements(_n(), "a[href]"), lambda n: ~n["attrs"]["href"].rlike("^(?:#|javascript:|mailto:)")))
    return d.select("page_id", "url", "title", "text", X.word_count(F.col("text")).alias("word_count"), X.language_of(F.col("text")).alias("language"),
                    X.quality_score(F.col("text")).alias("quality"), n_links.alias("n_links"),
                    F.size(image_array(F.col("url"))).alias("n_images"), (F.length("text") > 0).alias("success"))


def select_fields(df: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """One column per named selector: text of the first match, '' when there is none."""
    return df.select("page_id", *[F.coalesce(clean_of(dom.first(_n(), s)), F.lit("")).alias(name) for name, s in selectors.items()])


def schema_rows(df: DataFrame, base: str, fields: list[dict]) -> DataFrame:
    """One row per element of the base selector; fields are {name, selector, type: text|attribute|html, attribute}."""
    d = df.select("page_id", "url", "nodes", "body_text", F.posexplode(dom.elements(_n(), base)).alias("item", "b"))
    cols = []
    for f in fields:
        hit = F.get(dom.inside(_n(), F.col("b"), f["selector"]), F.lit(0))
        if f.get("type") == "attribute":
            v = hit["attrs"][f["attribute"]]
            v = F.when(F.lit(f["attribute"] in ("href", "src")) & v.isNotNull(), U.resolve(F.col("url"), v)).otherwise(v)
        else:
            v = clean_of(hit)
        cols.append(F.coalesce(v, F.lit("")).alias(f["name"]))
    return d.select("page_id", "item", *cols)


# Preset rules (selector, attribute, conversion).
COMMON_RULES = (("a", "href", "urls_resolved"), ("a", "title", "cleaned"), ("img", "src", "urls_resolved"), ("img", "alt", "cleaned"),
                ("img", "title", "cleaned"), ("form", "action", "urls_resolved"), ("form", "method", "raw"), ("input", "type", "raw"),
                ("input", "name", "raw"), ("meta[name]", "name", "raw"), ("meta[name]", "content", "cleaned"),
                ("meta[property]", "property", "raw"), ("meta[property]", "content", "cleaned"), ("script", "src", "urls_resolved"),
                ("link", "href", "urls_resolved"), ("link", "rel", "raw"), ("[itemtype]", "itemtype", "raw"),
                ("[itemprop]", "itemprop", "raw"), ("[id]", "id", "raw"), ("[class]", "class", "list"))


def attribute_values(df: DataFrame, rules=COMMON_RULES, limit: int | None = None, pattern: str | None = None, distinct: bool = True) -> DataFrame:
    """Long form (page, selector, attribute, pos, value) of all rules at once."""
    packs = []
    for sel, attr, kind in rules:
        vals = F.filter(F.transform(dom.elements(_n(), sel), _converter(attr, kind)), lambda v: v.isNotNull())
        vals = F.filter(vals, lambda v: AT.valid(v, pattern)) if pattern else vals
        vals = F.array_distinct(vals) if distinct else vals
        vals = F.slice(vals, 1, limit) if limit else vals
        packs.append(F.transform(vals, _labeller(sel, attr)))
    return df.select("page_id", F.explode(F.concat(*packs)).alias("v")).select("page_id", "v.*")


def _converter(attr, kind):
    return lambda n: F.when(n["attrs"][attr].isNotNull(), AT.converted(n["attrs"][attr], kind, F.col("url")))


def _labeller(sel, attr):
    return lambda v, i: F.struct(F.lit(sel).alias("selector"), F.lit(attr).alias("attribute"), i.alias("pos"), v.alias("value"))


def css_entities(df: DataFrame, per_selector: int | None = None) -> DataFrame:
    """Title, price, description, author and date elements, all or the first few per selector, confidence 0.7."""
    selectors = {"title": ("h1", "h2", ".title", "#title"), "price": (".price", ".cost", "[data-price]"),
                 "description": (".description", ".summary", ".excerpt"), "author": (".author", ".by", "[rel=author]"), "date": (".date", ".published", "time")}
    few = lambda c: F.slice(c, 1, per_selector) if per_selector else c
    packs = [F.transform(few(dom.elements(_n(), s)), _entity(kind, s)) for kind, ss in selectors.items() for s in ss]
    return df.select("page_id", F.explode(F.concat(*packs)).alias("e")).select("page_id", "e.*")


def _entity(kind, sel):
    return lambda n, i: F.struct(F.lit(kind).alias("entity_type"), F.lit(sel).alias("selector"), i.alias("idx"), clean_of(n).alias("value"), F.lit(0.7).alias("confidence"))


# ---- previews -------------------------------------------------------------------------------------------------

def preview(df: DataFrame, max_keywords: int = 10, length: int = 500) -> DataFrame:
    """Preview metadata of a page: best title, description and image, canonical, language, viewport, preview, keywords."""
    m = lambda a, v: dom.meta(_n(), a, v)
    canonical = U.resolve(F.col("url"), F.get(F.filter(_n(), lambda n: (n["tag"] == "link") & (n["attrs"]["rel"] == "canonical")), F.lit(0))["attrs"]["href"])
    has_canonical = F.exists(_n(), lambda n: (n["tag"] == "link") & (n["attrs"]["rel"] == "canonical"))
    picks = [F.nullif(clean_of(dom.first(_n(), s)), F.lit("")) for s in PREVIEW_SELECTORS]
    body = dom.first(_n(), "body")
    parts = F.array_join(F.transform(F.concat(dom.elements(_n(), "h1,h2,h3,h4,h5,h6"), dom.elements(_n(), "b,strong,i,em"), F.slice(dom.elements(_n(), "p"), 1, 1)), text_of), " ")
    ws = F.filter(F.regexp_extract_all(F.lower(parts), F.lit(r"\b([a-z]{3,})\b"), 1), lambda w: ~w.isin(KEYWORD_STOP))
    counted = let(ws, lambda a: F.transform(F.array_distinct(a), lambda w, i: F.struct(
        (-F.size(F.filter(a, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w"))))
    found = F.transform(F.slice(F.array_sort(counted), 1, max_keywords), lambda x: x["w"])
    declared = F.filter(F.transform(F.split(m("name", "keywords"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(
        "page_id", "url", F.coalesce(m("property", "og:title"), m("name", "twitter:title"), F.nullif(clean_of(dom.first(_n(), "title")), F.lit(""))).alias("title"),
        F.coalesce(m("property", "og:description"), m("name", "twitter:description"), m("name", "description")).alias("description"),
        F.coalesce(m("property", "og:image"), m("name", "twitter:image")).alias("image"), F.when(has_canonical, canonical).alias("canonical"),
        dom.first(_n(), "html")["attrs"]["lang"].alias("language"), m("name", "viewport").alias("viewport"),
        F.substring(F.coalesce(*picks, clean_of(body)), 1, length).alias("preview"), F.length(text_of(body)).alias("content_length"),
        F.coalesce(F.when(F.size(declared) > 0, declared), found).alias("keywords"))


def preview_scores(p: DataFrame, query_tokens: Column, status: Column, seconds: Column, content_type: Column) -> DataFrame:
    """Query overlap, and quality = .4 metadata + .3 content + .3 technical."""
    txt = F.lower(F.concat_ws(" ", "title", "description", "preview", F.array_join("keywords", " ")))
    toks = F.array_distinct(F.regexp_extract_all(txt, F.lit(r"\b([a-z]+)\b"), 1))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    meta = (plus(has("title"), 0.25) + plus(has("description"), 0.25) + plus(has("image"), 0.15) + plus(has("canonical"), 0.1)
            + plus(has("language"), 0.05) + plus(F.coalesce(F.size("keywords") > 0, F.lit(False)), 0.2))
    n, size = F.coalesce(F.length("preview"), F.lit(0)), F.coalesce(F.col("content_length"), F.lit(0))
    content = (F.when(n == 0, 0.0).when(n.between(100, 500), 0.3).when(n > 50, 0.2).otherwise(0.1)
               + F.when(size.between(1000, 10000), 0.2).when(size > 500, 0.1).otherwise(0.0))
    technical = (F.when(status == 200, 0.4).when(status.between(200, 299), 0.3).otherwise(0.0)
                 + F.when(seconds < 2, 0.3).when(seconds < 5, 0.1).otherwise(0.0) + plus(F.contains(content_type, F.lit("html")), 0.3))
    return p.withColumn("relevance", F.size(F.array_intersect(query_tokens, toks)) / F.size(query_tokens)).withColumn(
        "quality", F.least(F.lit(1.0), meta * 0.4 + content * 0.3 + technical * 0.3))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns that are computed once per row. A filter or a column above is moved below a projection together with a copy of
    what it reads, but not below a generator, here of one row."""
    made = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.withColumns({n: F.col("_once")[n] for n in columns}).drop("_once")


# ---- tables ---------------------------------------------------------------------------------------------------

def tables(df: DataFrame) -> DataFrame:
    """One row per <table>: its node, index, and the nodes below it."""
    d = df.select("page_id", "url", "body_text", "nodes", F.posexplode(dom.elements(_n(), "table")).alias("table_no", "tb"))
    return once(d, {"sub": dom.inside(_n(), F.col("tb"))}).drop("nodes")


def _count(tags: str) -> Column:
    return F.size(dom.elements(F.col("sub"), tags))


def _row_widths() -> Column:
    rows, cells = dom.elements(F.col("sub"), "tr"), dom.elements(F.col("sub"), "td,th")
    return let(cells, lambda cs: F.transform(rows, lambda r: F.size(F.filter(cs, lambda c: (c["id"] > r["id"]) & (c["id"] <= r["last"])))))


def _class_hits(words) -> Column:
    cls = F.lower(F.coalesce(F.col("tb.attrs")["class"], F.lit("")))
    return sum((F.contains(cls, F.lit(w)).cast("int") for w in words), F.lit(0))


def table_scores(t: DataFrame) -> DataFrame:
    """Data-table score and complexity. Weights and the keep (7) and review (15) limits."""
    d = t.withColumns({"th": _count("th"), "rows": _count("tr"), "widths": _row_widths()})
    at, widest = F.col("tb.attrs"), F.coalesce(F.array_max("widths"), F.lit(0))
    regular = F.size(F.array_distinct("widths")) == 1
    cells = dom.elements(F.col("sub"), "td,th")
    def holders(tags):
        return let(dom.elements(F.col("sub"), tags), lambda xs: F.size(F.filter(cells, lambda c: F.exists(xs, lambda x: (x["id"] > c["id"]) & (x["id"] <= c["last"])))))
    score = (F.when(F.col("th") > 0, F.least(F.col("th"), F.lit(5)) + 5).otherwise(0) + F.when(_count("thead") > 0, 3).otherwise(0)
             + F.when(_count("tbody") > 0, 2).otherwise(0) + F.when(_count("caption") > 0, 2).otherwise(0)
             + F.when(F.coalesce(at["summary"], F.lit("")) != "", 1).otherwise(0)
             + F.when(F.col("rows") > 5, 3).when(F.col("rows") > 2, 1).otherwise(0) + F.when(regular, 2).otherwise(0)
             + F.when(widest > 4, 2).when(widest > 2, 1).otherwise(0)
             + sum((F.when(F.coalesce(at[a], F.lit("")) != "", 1).otherwise(0) for a in ("data-table", "data-grid", "sortable")), F.lit(0))
             + _class_hits(("data", "grid", "sortable", "results", "listing")) - _class_hits(("layout", "wrapper", "container", "nav")) * 2
             - F.when(_count("input,select,textarea") > 0, 3).otherwise(0))
    spans = F.size(F.filter(cells, lambda c: c["attrs"]["colspan"].isNotNull())) + F.size(F.filter(cells, lambda c: c["attrs"]["rowspan"].isNotNull()))
    complexity = (_count("table") * 3 + spans * 2 + F.floor(F.col("rows") / 5) + F.floor(widest / 3) + holders("ul,ol") * 2
                  + holders("input,select,textarea") * 2 + holders("img") + F.when(F.size(F.array_distinct("widths")) > 1, 3).otherwise(0))
    return d.withColumn("score", F.greatest(F.lit(0), score)).withColumn("complexity", complexity.cast("int")).drop("th", "rows", "widths")


def table_rows(t: DataFrame) -> DataFrame:
    """headers array<string> and rows array<array<struct<text, links>>>; colspan pads with empty cells."""
    sub = F.col("sub")
    trs, cells = dom.elements(sub, "tr"), dom.elements(sub, "td,th")
    within = lambda arr, o: F.filter(arr, lambda n: (n["id"] > o["id"]) & (n["id"] <= o["last"]))
    thead, tbody = dom.first(sub, "thead"), dom.first(sub, "tbody")
    head_like = let(F.get(trs, F.lit(0)), lambda r: let(within(cells, r), lambda cs: F.size(
        F.filter(cs, lambda c: c["tag"] == "th")) > F.size(F.filter(cs, lambda c: c["tag"] == "td"))))
    d = once(t, {"trs": trs, "cells": cells, "anchors": dom.elements(sub, "a[href]"), "thead": thead, "tbody": tbody,
                       "head1": F.coalesce(head_like, F.lit(False))})
    head = F.when(F.col("thead").isNotNull(), within(F.col("trs"), F.col("thead"))).when(F.col("head1"), F.slice("trs", 1, 1)).otherwise(F.slice("trs", 1, 0))
    body = (F.when(F.col("thead").isNotNull() & F.col("tbody").isNotNull(), within(F.col("trs"), F.col("tbody")))
            .when(F.col("thead").isNotNull(), F.filter("trs", lambda r: r["id"] > F.col("thead.last")))
            .when(F.col("head1"), F.slice("trs", F.lit(2), F.greatest(F.size("trs") - 1, F.lit(0)))).otherwise(F.col("trs")))
    cell_t = "struct<text:string,links:array<struct<text:string,url:string>>>"
    pad = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<text:string,url:string>>").alias("links")).cast(cell_t)

    def cell(c, anchors):
        hrefs = F.transform(F.filter(anchors, lambda a: (a["id"] > c["id"]) & (a["id"] <= c["last"])),
                            lambda a: F.struct(clean_of(a).alias("text"), U.resolve(F.col("url"), a["attrs"]["href"]).alias("url")))
        extra = F.greatest(F.coalesce(c["attrs"]["colspan"].try_cast("int"), F.lit(1)) - 1, F.lit(0))
        return F.concat(F.array(F.struct(clean_of(c).alias("text"), hrefs.alias("links"))), F.array_repeat(pad, extra))

    # bound once: a column used inside a lambda would otherwise be inlined and evaluated per cell
    rows = let(F.col("anchors"), lambda an: let(F.col("cells"), lambda cs: F.transform(
        body, lambda r: F.flatten(F.transform(within(cs, r), lambda c: cell(c, an))))))
    headers = let(F.get(head, F.lit(0)), lambda h: F.transform(within(F.col("cells"), h), clean_of))

    def checked(rs):
        chars = F.aggregate(F.flatten(rs), F.lit(0), lambda a, c: a + F.length(c["text"]))
        valid = (F.size(rs) >= 2) & (F.array_max(F.transform(rs, lambda r: F.size(r))) >= 2) & (chars >= 10)
        return F.struct(rs.alias("rows"), F.coalesce(valid, F.lit(False)).alias("valid"))

    out = once(d, {"headers": F.coalesce(headers, F.array().cast("array<string>")), "_t": let(F.filter(rows, lambda r: F.size(r) > 0), checked),
                         "caption": clean_of(dom.first(sub, "caption"))})
    return out.withColumns({"rows": F.col("_t.rows"), "valid": F.col("_t.valid")}).drop("trs", "cells", "anchors", "thead", "tbody", "head1", "_t")


def table_markdown(headers: Column, rows: Column) -> Column:
    n = F.size(headers)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    shown = lambda c: F.when(F.size(c["links"]) > 0, F.concat(F.lit("["), c["links"][0]["text"], F.lit("]("), c["links"][0]["url"], F.lit(")"))).otherwise(c["text"])
    body = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(shown(F.get(r, i)), F.lit("")))))
    return F.array_join(F.concat(F.array(line(headers), line(F.transform(headers, lambda h: F.lit("---")))), body), "\n")


# ---- blocks ---------------------------------------------------------------------------------------------------

def blocks(df: DataFrame) -> DataFrame:
    """Text blocks (page_id, block, tag, text, score): included tags outside dropped ones, not deep in layout
    divs, long enough; the score adds tag and class hints."""
    def banned(n, drops):
        return F.exists(drops, lambda d: (n["id"] >= d["id"]) & (n["id"] <= d["last"]))

    drops = dom.elements(_n(), ",".join(DROPPED_TAGS))
    keep = let(drops, lambda d: F.filter(_n(), lambda n: n["tag"].isin(BLOCK_TAGS) & ~banned(n, d)))

    def chain_divs(n, divs):
        """divs among the five nearest ancestors: ancestors contain the node and lie at most five levels up."""
        return F.size(F.filter(divs, lambda a: (a["id"] < n["id"]) & (a["last"] >= n["last"]) & (a["depth"] >= n["depth"] - 5)))

    def rows(n, drops, divs):
        hints = sum(((F.contains(F.lower(F.coalesce(n["attrs"]["class"], F.lit(""))), F.lit(h))).cast("int") * 3
                     + F.contains(F.lower(F.coalesce(n["attrs"]["id"], F.lit(""))), F.lit(h)).cast("int") * 3 for h in CONTENT_HINTS), F.lit(0))
        # dropped elements inside the block do not count as its text
        gone = F.filter(drops, lambda d: (d["id"] > n["id"]) & (d["last"] <= n["last"]))
        spans = F.array_sort(F.transform(gone, lambda g: F.struct(g["t0"].alias("a"), g["t1"].alias("b"))))
        own = F.aggregate(spans, F.struct(n["t0"].alias("at"), F.lit("").alias("s")), lambda acc, x: F.struct(
            F.greatest(acc["at"], x["b"]).alias("at"),
            F.concat(acc["s"], F.when(x["a"] > acc["at"], F.substring(_b(), acc["at"] + 1, x["a"] - acc["at"])).otherwise("")).alias("s")))
        body = let(own, lambda o: F.concat(o["s"], F.substring(_b(), o["at"] + 1, n["t1"] - o["at"])))
        return F.struct(n["id"].alias("block"), n["tag"].alias("tag"), X.squeeze(body).alias("text"), chain_divs(n, divs).alias("divs"),
                        (lookup(n["tag"], TAG_SCORES, 0) + hints).alias("score"))

    d = df.select("page_id", F.explode(let(drops, lambda dr: let(dom.elements(_n(), "div"), lambda divs: F.transform(keep, lambda n: rows(n, dr, divs))))).alias("b")).select("page_id", "b.*")
    words = X.word_count(F.col("text"))
    semantic = F.col("tag").isin("article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6")
    return d.where((F.col("divs") <= 3) & (semantic | ((F.length("text") > 20) & (words >= 5))) & (words >= 3)).withColumn("words", words).drop("divs")


def prune(b: DataFrame, threshold: float = 0.48, adaptive: bool = False, min_words: int = 0) -> DataFrame:
    """Adds keep and the page's relevance; when nothing passes on a page every block is kept."""
    from pyspark.sql import Window
    w = Window.partitionBy("page_id")
    limit = F.greatest(F.lit(threshold), F.avg("score").over(w) - 0.5 * F.stddev_pop("score").over(w)) if adaptive else F.lit(threshold)
    d = b.withColumn("_pass", (F.col("score") / 10 >= limit) & (F.col("words") >= min_words))
    n_pass, total = F.count_if("_pass").over(w), F.sum(F.when(F.col("_pass"), F.col("score")).otherwise(0)).over(w)
    return (d.withColumn("keep", F.col("_pass") | (n_pass == 0))
            .withColumn("relevance", F.least(F.lit(1.0), total / (F.count(F.lit(1)).over(w) * 10.0))).drop("_pass"))
