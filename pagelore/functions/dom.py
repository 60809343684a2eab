"""HTML pages as node arrays.

A page is parsed once, in an Arrow function that only turns tags into rows: `text` is the visible text
of the page, and each element holds its tag, attributes, tree links and the text range [t0, t1) it covers.
Everything built on top (selectors, links, tables, Markdown) is column work inside the page row: no
shuffle, and the Python stage runs once per page because the result is kept as a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_once
from .text import free_character, guarded

NODE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t0", T.IntegerType()), T.StructField("t1", T.IntegerType()),
    T.StructField("open", T.IntegerType()), T.StructField("close", T.IntegerType()),
    T.StructField("raw", T.StringType())])
PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])

VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = {"script", "style", "noscript", "template"}
# An opening tag that ends an open element of the listed kinds.
ENDS = {**{t: {"p"} for t in ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header "
                              "hr main nav ol p pre section table ul").split()},
        "li": {"li", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "thead": {"caption"}, "tbody": {"thead", "tr", "td", "th", "caption"},
        "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"},
         "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class _Rows(HTMLParser):
    """Collects node rows; an end tag closes up to its start, unclosed tags end with their parent."""

    def __init__(self, guard: str):
        super().__init__(convert_charrefs=True)
        self.guard = guard  # stands for an & that starts no whole reference, see parse_one
        self.rows: list[dict] = []
        self.stack: list[int] = []
        self.parts: list[str] = []
        self.n = 0
        self.seq = 0

    def _shut(self, depth: int):
        while len(self.stack) > depth:
            r = self.rows[self.stack.pop()]
            r["last"], r["t1"], r["close"] = len(self.rows) - 1, self.n, self.seq
            self.seq += 1

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag)
        if ends:
            stop = SCOPE.get(tag, {"td", "th", "table", "button"})
            for d in range(len(self.stack) - 1, -1, -1):
                t = self.rows[self.stack[d]]["tag"]
                if t in ends:
                    self._shut(d)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif t in stop:
                    break
        i = len(self.rows)
        self.rows.append({"id": i, "parent": self.stack[-1] if self.stack else -1, "last": i, "depth": len(self.stack),
                          "tag": tag, "attrs": [(k.replace(self.guard, "&"), (v or "").replace(self.guard, "&")) for k, v in dict(attrs).items()],
                          "t0": self.n, "t1": self.n, "open": self.seq, "close": self.seq, "raw": None})
        self.seq += 1
        if tag in VOID:
            self.rows[i]["close"] = self.seq
            self.seq += 1
        else:
            self.stack.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack:
            self._shut(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for d in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[d]]["tag"] == tag:
                return self._shut(d)

    def handle_data(self, data):
        data = data.replace(self.guard, "&")
        if self.stack and any(self.rows[s]["tag"] in HIDDEN for s in self.stack[-2:]):
            r = self.rows[self.stack[-1]]
            r["raw"] = (r["raw"] or "") + data
        else:
            self.parts.append(data)
            self.n += len(data)


def parse_one(html: str | None) -> dict:
    """Rows of a page; a character reference ends in a semicolon, everything else that starts with & is text."""
    html = html or ""
    guard = free_character(html)
    p = _Rows(guard)
    p.feed(guarded(html, guard))
    p.close()
    p._shut(0)
    return {"text": "".join(p.parts), "nodes": p.rows}


_ARROW = pa.struct([("text", pa.string()), ("nodes", pa.list_(pa.struct([
    ("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("t0", pa.int32()), ("t1", pa.int32()), ("open", pa.int32()),
    ("close", pa.int32()), ("raw", pa.string())])))])


PAGES_AT_ONCE = 32
_SPACE = r"[ \t\n\r\f]"
_OPEN = re.compile(rf"""([a-zA-Z][a-zA-Z0-9]*)((?:{_SPACE}+[a-zA-Z][a-zA-Z0-9_:-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/]+))?)*){_SPACE}*(/?)""")
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'/]+)))?""")
_CLOSE = re.compile(rf"/([a-zA-Z][a-zA-Z0-9]*){_SPACE}*")
_COMMENT = re.compile(r"!--[^->]+-->|!(?i:doctype) (?i:html)>")
# Elements whose content is no plain markup, or not so in every version of the parser.
_OTHER = {"noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "plaintext", "svg", "math"}
_GUARD = chr(0xE000)
_TAGS: dict[str, tuple] = {}


def _plain(s: str) -> str:
    return unescape(guarded(s, _GUARD)).replace(_GUARD, "&") if "&" in s else s


def _tag(head: str) -> tuple:
    """(kind, tag, attributes) of what stands between < and >: 1 opens, 2 opens and closes, 0 closes, -1 is no simple tag. Kept by its text."""
    if m := _CLOSE.fullmatch(head):
        out = 0, m[1].lower(), ()
    elif (m := _OPEN.fullmatch(head)) and m[1].lower() not in _OTHER and not (m[3] and "=" in m[2] and head[-2] not in "\"' \t\n\r\f"):
        attrs = {a[1].lower(): _plain(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[2])}
        out = 2 if m[3] else 1, m[1].lower(), tuple(attrs.items())
    else:
        out = -1, "", ()
    if len(_TAGS) >= 20_000:
        _TAGS.clear()
    _TAGS[head] = out
    return out


def _simple_rows(html: str) -> tuple[str, list[tuple]] | None:
    """Text and node rows (in the order of NODE) of simple markup, the same as those of `parse_one` in a fraction of its time.

    None for a page with anything else: open quotes, single <, markup in comments, elements of _OTHER, a character used as guard.
    """
    if _GUARD in html:
        return None
    pieces = iter(html.split("<"))
    data = next(pieces)
    parts, n, seq = [], 0, 0
    if data:
        parts.append(_plain(data))
        n = len(parts[0])
    rows, stack, tags = [], [], []

    def shut(depth: int) -> None:
        nonlocal seq
        while len(stack) > depth:
            r = rows[stack.pop()]
            tags.pop()
            r[2], r[7], r[9] = len(rows) - 1, n, seq
            seq += 1

    for piece in pieces:
        head, end, data = piece.partition(">")
        if not end:
            return None
        kind, tag, attrs = _TAGS.get(head) or _tag(head)
        if kind > 0:
            ends = ENDS.get(tag)
            if ends:
                stop = SCOPE.get(tag, _STOP)
                for d in range(len(tags) - 1, -1, -1):
                    t = tags[d]
                    if t in ends:
                        shut(d)
                        if tag not in _THROUGH:
                            break
                    elif t in stop:
                        break
            i = len(rows)
            row = [i, stack[-1] if stack else -1, i, len(stack), tag, attrs, n, n, seq, seq, None]
            rows.append(row)
            seq += 1
            if tag in VOID:
                row[9] = seq
                seq += 1
            else:
                stack.append(i)
                tags.append(tag)
                if kind == 2:
                    shut(len(stack) - 1)
                elif tag in _RAW:
                    # its content goes up to its end tag, whatever stands between
                    raw, name = data, "/" + tag
                    for piece in pieces:
                        if piece[:len(name)].lower() == name:
                            break
                        if piece[:1] == "/" and piece[1:].lstrip()[:len(tag)].lower() == tag:
                            return None
                        raw += "<" + piece
                    else:
                        return None
                    head, end, data = piece.partition(">")
                    if not end or head.lower() != name:
                        return None
                    row[10] = raw or None
                    shut(len(stack) - 1)
        elif kind == 0:
            for d in range(len(tags) - 1, -1, -1):
                if tags[d] == tag:
                    shut(d)
                    break
        else:
            m = _COMMENT.match(piece)
            if not m:
                return None
            data = piece[m.end():]
        if data:
            data = _plain(data)
            parts.append(data)
            n += len(data)
    shut(0)
    return "".join(parts), rows


_STOP, _THROUGH, _RAW = {"td", "th", "table", "button"}, {"tr", "tbody", "tfoot"}, {"script", "style"}


def _parsed(pages: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """Texts and node arrays of some pages. Nodes are laid out by column; as a list of dicts they would take Arrow longer than the parser."""
    texts, at, nodes = [], [0], []
    for html in pages:
        found = _simple_rows(html or "")
        if found is None:
            p = parse_one(html)
            found = p["text"], [tuple(r.values()) for r in p["nodes"]]
        texts.append(found[0])
        nodes += found[1]
        at.append(len(nodes))
    cols = list(zip(*nodes, strict=True)) or [()] * len(NODE)
    pairs = [p for attrs in cols[5] for p in attrs]
    attr_at = pa.array(accumulate(map(len, cols[5]), initial=0), pa.int32())
    types = _ARROW.field("nodes").type.value_type
    made = [pa.MapArray.from_arrays(attr_at, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())) if types[i].name == "attrs"
            else pa.array(c, types[i].type) for i, c in enumerate(cols)]
    return pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(made, fields=list(types)))


@F.arrow_udf(PARSED)
def parse_html(v: pa.Array) -> pa.Array:
    # a few pages at a time: their nodes as Python objects take many times the room of the Arrow array
    parts = [pa.StructArray.from_arrays(_parsed(v.slice(i, PAGES_AT_ONCE).to_pylist()), fields=list(_ARROW)) for i in range(0, len(v), PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `body_text` and `nodes`, keeps the other columns except the markup. A worker holds the pages of one Arrow batch and
    the nodes of PAGES_AT_ONCE of them, whatever the length of its partition."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                b = batch.slice(i, PAGES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_parsed(b.column(len(keep)).to_pylist())], names=[*keep, "body_text", "nodes"])

    kept = pages.select(*keep, F.col(html).alias("_html"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("body_text", PARSED["text"].dataType), T.StructField("nodes", PARSED["nodes"].dataType)])
    return kept.mapInArrow(run, schema)


def parsed_pages(t) -> DataFrame:
    """Parsed form of the page table, built once per application and read back as Parquet."""
    return table_once(t.spark, t.folder, "parsed_pages", lambda: parse_pages(t.spread("pages")))


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)?|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[\^*$]?=)['"]?(?P<val>[^'"\]]*)['"]?)?\]""",
                     re.X)


def matches(node: Column, selector: str) -> Column:
    """Predicate for one compound selector (tag, .class, #id, [attr], [attr=v], ^= *= $=) or a comma list."""
    out = F.lit(False)
    for sel in selector.split(","):
        ok = F.lit(True)
        for m in _SIMPLE.finditer(sel.strip()):
            g = m.groupdict()
            if g["tag"] and g["tag"] != "*":
                ok = ok & (node["tag"] == g["tag"].lower())
            elif g["cls"]:
                ok = ok & F.array_contains(F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"\s+"), g["cls"])
            elif g["id"]:
                ok = ok & F.coalesce(node["attrs"]["id"] == g["id"], F.lit(False))
            elif g["attr"]:
                a = node["attrs"][g["attr"].lower()]
                v = F.lit(g["val"])
                test = {None: a.isNotNull(), "=": a == v, "^=": F.startswith(a, v), "*=": F.contains(a, v),
                        "$=": F.endswith(a, v)}[g["op"]]
                ok = ok & F.coalesce(test, F.lit(False))
        out = out | ok
    return out


def elements(nodes: Column, selector: str) -> Column:
    return F.filter(nodes, lambda n: matches(n, selector))


def inside(nodes: Column, outer: Column, selector: str | None = None) -> Column:
    """Descendants of one node."""
    return F.filter(nodes, lambda n: (n["id"] > outer["id"]) & (n["id"] <= outer["last"])
                    & (matches(n, selector) if selector else F.lit(True)))


def text_of(body_text: Column, node: Column) -> Column:
    return F.substring(body_text, node["t0"] + 1, node["t1"] - node["t0"])


def first(nodes: Column, selector: str) -> Column:
    return F.get(elements(nodes, selector), F.lit(0))


def meta(nodes: Column, name: str, value: str) -> Column:
    """content of the first <meta> whose attribute `name` has the given value (case ignored)."""
    hit = F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.lower(n["attrs"][name]) == value)
                   & (F.trim(F.coalesce(n["attrs"]["content"], F.lit(""))) != ""))
    return F.trim(F.get(hit, F.lit(0))["attrs"]["content"])


def visible_text(body_text: Column, nodes: Column, drop: str) -> Column:
    """Page text without the ranges of the dropped elements (nav, footer, ...)."""
    spans = F.transform(elements(nodes, drop), lambda n: F.struct(n["t0"].alias("a"), n["t1"].alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
    folded = F.aggregate(F.array_sort(spans), start, lambda acc, x: F.struct(
        F.greatest(acc["at"], x["b"]).alias("at"),
        F.concat(acc["s"], F.when(x["a"] > acc["at"], F.substring(body_text, acc["at"] + 1, x["a"] - acc["at"])).otherwise("")).alias("s")))
    return F.concat(folded["s"], F.substring(body_text, folded["at"] + 1, F.length(body_text)))
