"""Main text of pages by equivalence-class template deduction.

1. A page is cut once into a sequence of elements and block texts, boilerplate included. Tokens are the elements, by their
   path of tag names with class or id, and the block texts at their path.
2. Over the pages of a host, a token's occurrence vector says how often it is on each page. Vectors are compared as
   sums of hashes over the pages, so a host of any size is one aggregate with a map-side part, and no page list is
   collected. Copies of a page (same sequence) count once.
3. Tokens with the same vector form a class. It is large and frequent if its tokens occur once on each of its pages, on at
   least `min_pages` different pages and `min_share` of its host's. The class on most pages is the root. Classes nest
   in the slots between the root's tokens: a class is cut by the slot its tokens lie in, tokens that change their slot are
   dropped, and a class is valid if its tokens stand in one order on all of its pages; a root needs an element.
4. The tokens of the valid classes cut every page into slots: a slot is the last of them before a text, and the innermost of
   them around it. What lies in a slot on all pages of the host, its words and linked words, is one aggregate.
5. Slots are chosen per host: those in an article of the template, else in its main element, else those of the body with
   fewer linked words than others. Slots in an element that is boilerplate by tag or role, or by its class where that
   element is part of the template, are left out; a class alone takes nothing away. Texts that are template tokens are no
   content. The chosen slots' texts, in page order, are the main text.

Fallback, for hosts with fewer than `min_pages` different pages and for pages without a text in a chosen slot: the texts of
the page's article, else main, else the rest, outside of elements that are boilerplate by tag, role or class.

Cases: a null or empty page gives the empty text; a null url is a host of its own; a page without article, main or
body is taken whole; unclosed tags end with their parents; repeated pages and ties give equal rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, scratch_path

MIN_PAGES = 10
MIN_SHARE = 0.6

# Fixed values of HTML: elements without an end tag, elements whose content is not markup, elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"))
BLOCKS = frozenset((
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split())
# An opening tag that ends an open element of the named kinds, and where the search for it stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
         "tbody": ("table",), "tfoot": ("table",), "option": ("select", "datalist")}
# Zones that are not the article: by element, by role, by a word of class or id.
DROP_TAGS = frozenset(("head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea",
                       "svg", "canvas", "object", "dialog", "menu", "search", "title", "xmp", "noembed", "noframes", "datalist"))
DROP_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"))
DROP_WORDS = frozenset(("nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts",
                        "advertisement", "advertising", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "promo", "promotion", "sponsor", "sponsored",
                        "comment", "comments", "disqus", "share", "sharing", "social", "related", "newsletter", "subscribe", "subscription", "signup", "breadcrumb",
                        "breadcrumbs", "popup", "modal", "overlay", "pagination", "pager", "widget", "toolbar", "skip", "login", "form"))
# Words that say nothing about a class name, and names of reader comments.
NEUTRAL_WORDS = frozenset(("site", "page", "top", "bottom", "left", "right", "global", "main", "container", "wrapper", "box", "block", "section", "bar", "area", "list", "inner", "outer", "slot", "unit", "links"))
COMMENT_WORDS = frozenset(("comment", "comments", "disqus", "reply", "replies", "discussion"))
KEPT_TAGS = frozenset(("html", "body", "main", "article"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value))
    return out


HARD, SOFT = 1, 2
_TWO = struct.Struct("<qq")


def _names(names: str, words: frozenset) -> bool:
    """Whether one of the names is made of these words, neutral ones aside."""
    for name in names.split():
        parts = {w.lower() for w in _WORD.findall(name)}
        if parts & words and parts <= words | NEUTRAL_WORDS:
            return True
    return False


def _zone(tag: str, attrs: dict[str, str]) -> int:
    """Whether an element is boilerplate: HARD by tag, role, as hidden or as reader comments, SOFT by its class or id alone."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return 0 if tag in ("html", "body") else HARD
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag not in ("html", "body", "main") and _names(names, COMMENT_WORDS):
        return HARD
    if tag in KEPT_TAGS:
        return 0
    return HARD if tag in DROP_TAGS or attrs.get("role", "").lower() in DROP_ROLES else SOFT if _names(names, DROP_WORDS) else 0


def parse(html: str) -> list[tuple[str, int, int, int, int, int, str | None]]:
    """The page as (path, place of the enclosing element or -1, kind 0 element or 1 text, zone, rank, linked words, text): rank 3 is an
    article, 2 a main element. Inline elements are no items of their own unless they are boilerplate."""
    items: list[tuple[str, int, int, int, int, int, str | None]] = []
    # tag, place of its item, path, whether it is a link
    stack: list[tuple[str, int, str, bool]] = [("", -1, "", False)]
    text: list[str] = []
    linked: list[str] = []

    def flush():
        if text:
            words = unescape("".join(text)).split()
            if words:
                _, at, path, _ = stack[-1]
                items.append((path, at, 1, 0, 0, min(len(words), len(unescape(" ".join(linked)).split())), " ".join(words)))
            text.clear()
            linked.clear()

    def add(part: str):
        text.append(part)
        if stack[-1][3]:
            linked.append(part)

    def shut(depth: int):
        if stack[-1][1] != stack[depth - 1][1]:
            flush()
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes up to its start
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == tag:
                    shut(d)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        attrs = _attributes(m[3] if m[2] else m[6]) if (m[3] or m[6]) else {}
        if tag in BLOCKS:
            flush()
            for d in range(len(stack) - 1, 0, -1):
                kind = stack[d][0]
                if kind == "p" or kind in CLOSES.get(tag, ()):
                    shut(d)
                    if kind == "p" and tag in CLOSES:
                        continue
                elif kind in SCOPE.get(tag, ()) or (kind in BLOCKS and tag not in CLOSES):
                    break
        elif tag in CLOSES:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in CLOSES[tag]:
                    shut(d)
                elif stack[d][0] in SCOPE[tag]:
                    break
        _, above, path, link = stack[-1]
        if tag in VOID:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            continue
        zone = _zone(tag, attrs)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            text.append(" ")
            continue
        if tag in BLOCKS or zone:
            flush()
            path = f"{path}/" + ".".join([tag, *attrs.get("class", "").split()]) + (f"#{attrs['id']}" if attrs.get("id") else "")
            items.append((path, above, 0, zone, 3 if tag == "article" else 2 if tag == "main" or attrs.get("role") == "main" else 1, 0, None))
            above = len(items) - 1
        stack.append((tag, above, path, link or tag == "a"))
    flush()
    return items


_ITEMS = "array<struct<token:long,up:int,kind:tinyint,zone:tinyint,rank:tinyint,linked:int,text:string>>"
_ITEM = pa.struct([("token", pa.int64()), ("up", pa.int32()), ("kind", pa.int8()), ("zone", pa.int8()), ("rank", pa.int8()), ("linked", pa.int32()), ("text", pa.string())])
PARSED = f"page_id long, url string, host string, signature long, items {_ITEMS}"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its elements and block texts in page order, and the hash of that sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def token(*parts: str) -> int:
            return xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                signatures, ends, flat = [], [0], []
                for h in some.column(3):
                    items = [(token(path, text) if kind else token(path), up, kind, zone, rank, linked, text) for path, up, kind, zone, rank, linked, text in parse(h.as_py() or "")]
                    flat += items
                    ends.append(len(flat))
                    signatures.append(token(*(str(i[0]) for i in items)))
                columns = list(zip(*flat, strict=True)) or [[]] * 7
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ITEM, strict=True)], fields=list(_ITEM))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(signatures, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                                                 names=["page_id", "url", "host", "signature", "items"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html")).mapInArrow(run, PARSED)


def template(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, scratch: Scratch | None = None) -> DataFrame:
    """(host, token, is_text, class_id, n_pages, slot, place): the tokens of the valid classes of every host.

    A class is a host's tokens with the same occurrence vector in the same slot of the root class; `slot` is the number of root
    tokens before it (for the root itself -1) and `place` the token's order in its class.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    # copies of a page have the same signature, which is its name here, and so count once
    tokens = F.transform("items", lambda i: F.struct(i["token"].alias("token"), (i["kind"] == 1).alias("is_text")))
    pages = scratch.write(pages.select("host", "signature", tokens.alias("tokens")).dropDuplicates(["host", "signature"]), "tokens")
    of = pages.select("host", "signature", F.explode("tokens").alias("t"))
    per_page = of.groupBy("host", "signature", "t.token", "t.is_text").agg(F.count(F.lit(1)).alias("count"))
    vector = per_page.groupBy("host", "token", "is_text").agg(
        F.count(F.lit(1)).alias("n_pages"), F.max("count").alias("most"), F.sum(F.xxhash64("signature", "count").cast("decimal(20,0)")).alias("vector"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    able = vector.where((F.col("most") == 1) & (F.col("n_pages") >= min_pages)).join(hosts, "host").where(F.col("n_pages") >= min_share * F.col("host_pages"))
    # what is left occurs on most pages of its host, so it is no more than a page holds
    able = scratch.write(able.select("host", "token", "is_text", "n_pages", "vector"), "vectors")
    roots = able.groupBy("host", "n_pages", "vector").agg(F.count(F.lit(1)).alias("size")).groupBy("host").agg(
        F.max_by(F.struct("n_pages", "vector"), F.struct("n_pages", "size", "vector")).alias("root"))
    known = able.join(roots, "host").select("host", "token", "is_text", "n_pages", "vector", ((F.col("n_pages") == F.col("root.n_pages")) & (F.col("vector") == F.col("root.vector"))).alias("is_root"))
    table = known.groupBy("host").agg(F.collect_list(F.struct("token", "is_text", "n_pages", "vector", "is_root")).alias("known"))  # one page's worth
    lists = pages.select("host", "signature", F.transform("tokens", lambda t: t["token"]).alias("tokens")).join(table, "host")
    # per page: its able tokens in order, with the number of root tokens before each
    here = F.filter(F.transform("known", lambda k: F.struct(F.array_position("tokens", k["token"]).alias("at"), k["token"].alias("token"), k["is_text"].alias("is_text"), k["n_pages"].alias("n_pages"),
                                                              k["vector"].alias("vector"), k["is_root"].alias("is_root"))), lambda k: k["at"] > 0)
    placed = lists.select("host", "signature", F.array_sort(here).alias("here"))
    ranked = placed.select("host", "signature", F.posexplode(F.transform("here", lambda k: F.struct(
        k.alias("k"), F.when(k["is_root"], -1).otherwise(F.size(F.filter("here", lambda r: r["is_root"] & (r["at"] < k["at"])))).alias("slot")))).alias("nth", "x"))
    ranked = scratch.write(ranked.select("host", "signature", "nth", "x.k.token", "x.k.is_text", "x.k.n_pages", "x.k.vector", "x.slot"), "places")
    steady = ranked.groupBy("host", "token").agg(F.min("slot").alias("least"), F.max("slot").alias("most")).where("least = most").select("host", "token")
    ranked = ranked.join(steady, ["host", "token"], "left_semi")
    of_class = ["host", "n_pages", "vector", "slot"]
    orders = ranked.groupBy(*of_class, "signature").agg(F.array_sort(F.collect_list(F.struct("nth", "token", "is_text"))).alias("t"))  # one page's worth
    orders = orders.withColumn("t", F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["is_text"].alias("is_text"))))
    valid = orders.groupBy(*of_class).agg(F.count_distinct(F.xxhash64(F.transform("t", lambda x: x["token"]))).alias("orders"), F.any_value("t").alias("t"))
    valid = valid.where((F.col("orders") == 1) & ((F.col("slot") >= 0) | F.exists("t", lambda x: ~x["is_text"])))
    return valid.select("host", F.posexplode("t").alias("place", "x"), "n_pages", "vector", "slot").select(
        "host", "x.token", "x.is_text", F.xxhash64("n_pages", "vector", "slot").alias("class_id"), "n_pages", "slot", "place")


def _slot(last: int, inner: int) -> int:
    return zlib.crc32(_TWO.pack(last, inner)) << 31 ^ zlib.adler32(_TWO.pack(inner, last))


class Page:
    """The items of one page, walked with the tokens of its host's template."""

    def __init__(self, columns: dict[str, np.ndarray], a: int, b: int, tokens: frozenset):
        self.token, self.up, self.kind, self.zone, self.rank = (columns[c][a:b] for c in ("token", "up", "kind", "zone", "rank"))
        n, self.tokens = b - a, tokens
        # inherited from the elements around: hard or soft zones, soft zones of the template, rank, rank and innermost element of the template
        self.hard, self.soft, self.fixed_soft, self.inner_rank, self.template_rank, self.inner = [False] * n, [False] * n, [False] * n, [1] * n, [1] * n, [0] * n

    def slots(self) -> Iterator[tuple[int, int]]:
        """(place of a text, slot) in page order; a slot is 0 before any token."""
        last = 0
        for k, (t, up, kind, zone, rank) in enumerate(zip(self.token.tolist(), self.up.tolist(), self.kind.tolist(), self.zone.tolist(), self.rank.tolist(), strict=True)):
            mine = t in self.tokens
            if up >= 0:
                for of in (self.hard, self.soft, self.fixed_soft, self.inner_rank, self.template_rank, self.inner):
                    of[k] = of[up]
            if kind:
                if not mine:
                    yield k, _slot(last, self.inner[k])
            else:
                self.hard[k] |= zone == HARD
                self.soft[k] |= zone == SOFT
                self.fixed_soft[k] |= zone == SOFT and mine
                self.inner_rank[k] = max(self.inner_rank[k], rank)
                if mine:
                    self.template_rank[k], self.inner[k] = max(self.template_rank[k], rank), t
            if mine:
                last = t

    def fallback(self) -> list[int]:
        """Places of the texts of the article, else main, else the rest, outside of every zone."""
        texts = [k for k, _ in self.slots() if not self.hard[k] and not self.soft[k]]
        top = max((self.inner_rank[k] for k in texts), default=1)
        return [k for k in texts if self.inner_rank[k] == top]


def _pages(b: pa.RecordBatch, column: int) -> tuple[dict[str, np.ndarray], list[int], pa.Array, np.ndarray]:
    """The items of a batch as flat columns, where each page begins, the texts and the linked words."""
    items = b.column(column)
    flat = items.flatten()
    ends = np.concatenate([[0], np.cumsum(np.diff(items.offsets.to_numpy()))]).tolist()
    return {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("token", "up", "kind", "zone", "rank")}, ends, flat.field("text"), flat.field("linked").to_numpy(zero_copy_only=False)


def _slot_figures(pages: DataFrame) -> DataFrame:
    """(host, slot, rank, dropped, words, linked) over the pages of each host, from pages with their host's `tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, ends, texts, linked = _pages(b, 1)
            words = texts.fill_null("")
            total: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, tokens, a, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), ends, ends[1:], strict=False):
                page = Page(columns, a, z, frozenset(tokens))
                for k, slot in page.slots():
                    t = total[host, slot, page.template_rank[k], page.hard[k] or page.fixed_soft[k]]
                    t[0] += words[a + k].as_py().count(" ") + 1
                    t[1] += int(linked[a + k])
            rows = [(*key, *t) for key, t in total.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "slot", "rank", "dropped", "words", "linked"])

    rows = pages.select("host", "items", "tokens").mapInArrow(run, "host string, slot long, rank int, dropped boolean, words long, linked long")
    return rows.groupBy("host", "slot", "rank", "dropped").agg(F.sum("words").alias("words"), F.sum("linked").alias("linked"))


def _chosen(figures: DataFrame, most_linked: float = 0.5) -> DataFrame:
    """(host, slots): the slots of the article of the template, else of its main element, else those that are no lists of links."""
    open_ = figures.where("not dropped")
    top = open_.groupBy("host").agg(F.max("rank").alias("top"))
    text = (F.col("rank") > 1) | (F.col("linked") <= most_linked * F.col("words"))
    return open_.join(top, "host").where((F.col("rank") == F.col("top")) & text).groupBy("host").agg(F.collect_set("slot").alias("slots"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
              min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, by_template): the texts of the chosen slots, one per line, and whether the template chose them."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    at = scratch_path(spark, "items")
    parsed(pages, id_col, url_col, html_col).write.option("compression", "zstd").parquet(at)
    rows = spark.read.parquet(at)
    tokens = template(rows, min_pages, min_share, scratch).groupBy("host").agg(F.collect_set("token").alias("tokens"))
    tokens = scratch.write(tokens, "template")  # a row per host that has a template; its size on disk tells Spark how to join
    slots = scratch.write(_chosen(_slot_figures(rows.join(tokens, "host"))), "slots")
    known = scratch.write(tokens.join(slots, "host", "left"), "hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, ends, texts, _ = _pages(b, 2)
            out, how = [], []
            for tokens_, slots_, a, z in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), ends, ends[1:], strict=False):
                page, chosen = Page(columns, a, z, frozenset(tokens_ or ())), frozenset(slots_ or ())
                mine = [k for k, slot in page.slots() if slot in chosen and not page.hard[k] and not page.fixed_soft[k]]
                how.append(bool(mine))
                out.append("\n".join(texts[a + k].as_py() for k in mine or page.fallback()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(how)], names=["page_id", "url", "text", "by_template"])

    joined = rows.select("page_id", "url", "host", "items").join(known, "host", "left").select("page_id", "url", "items", "tokens", "slots")
    out = joined.mapInArrow(run, "page_id long, url string, text string, by_template boolean")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_template")
