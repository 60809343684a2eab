"""Parsed pages to Markdown or plain text, as a column.

Opening and closing of every element are laid out in document order; each gives a marker and the text up
to the next one. The rendering is a transform over that array, so pages are rendered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .dom import elements
from .text import let

BLOCKS = ("p", "div", "section", "article", "main", "header", "footer", "nav", "ul", "ol", "table", "blockquote", "pre",
          "h1", "h2", "h3", "h4", "h5", "h6", "title", "figure", "aside", "form")


def _under(n: Column, arr: Column) -> Column:
    """How many of the given elements contain the node."""
    return F.size(F.filter(arr, lambda a: (a["id"] < n["id"]) & (a["last"] >= n["id"])))


def _marker(e: Column, nodes: Column, lists: Column, pres: Column, base: Column, md: bool, links: bool, images: bool, emphasis: bool) -> Column:
    n, opens = e["n"], e["open"]
    tag = n["tag"]
    at = n["attrs"]
    parent = F.get(nodes, F.when(n["parent"] >= 0, n["parent"]))
    ordinal = F.size(F.filter(nodes, lambda x: (x["parent"] == n["parent"]) & (x["tag"] == "li") & (x["id"] <= n["id"])))
    indent = F.repeat(F.lit("  "), F.greatest(_under(n, lists) - 1, F.lit(0)))
    bullet = F.when(parent["tag"] == "ol", F.concat(ordinal.cast("string"), F.lit(". "))).otherwise("- " if md else "* ")
    in_pre = _under(n, pres) > 0
    code = F.get(F.filter(nodes, lambda x: (x["parent"] == n["id"]) & (x["tag"] == "code")), F.lit(0))
    lang = F.regexp_extract(F.coalesce(at["class"], code["attrs"]["class"], F.lit("")), r"lang(?:uage)?-([\w+-]+)", 1)
    cells = F.size(F.filter(nodes, lambda x: (x["parent"] == n["id"]) & x["tag"].isin("td", "th")))
    head_row = F.exists(nodes, lambda x: (x["parent"] == n["id"]) & (x["tag"] == "th"))
    first_cell = ~F.exists(nodes, lambda x: (x["parent"] == n["parent"]) & x["tag"].isin("td", "th") & (x["id"] < n["id"]))
    blank = F.lit("")
    out = F.when(tag == "br", F.when(opens, "\n").otherwise(blank))
    if md:
        out = (out.when(tag.rlike("^h[1-6]$"), F.when(opens, F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "))).otherwise("\n\n"))
               .when(tag == "hr", F.when(opens, "\n\n---\n\n").otherwise(blank))
               .when(tag == "blockquote", F.when(opens, "\n\n> ").otherwise("\n\n"))
               .when(tag == "pre", F.when(opens, F.concat(F.lit("\n\n```"), lang, F.lit("\n"))).otherwise("\n```\n\n"))
               .when((tag == "code") & ~in_pre, "`")
               .when(tag == "mark", "=="))
        if emphasis:
            out = out.when(tag.isin("strong", "b"), "**").when(tag.isin("em", "i"), "*")
        if links:
            out = out.when((tag == "a") & at["href"].isNotNull(), F.when(opens, "[").otherwise(F.concat(F.lit("]("), U.resolve(base, at["href"]), F.lit(")"))))
        if images:
            out = out.when((tag == "img") & at["src"].isNotNull(), F.when(opens, F.concat(F.lit("!["), F.coalesce(at["alt"], blank), F.lit("]("), U.resolve(base, at["src"]), F.lit(")"))).otherwise(blank))
        cell = F.when(opens, F.when(first_cell, "| ").otherwise(" | ")).otherwise(blank)
        row_end = F.concat(F.lit(" |"), F.when(head_row, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), cells))).otherwise(blank))
    else:
        if images:
            out = out.when((tag == "img") & at["alt"].isNotNull(), F.when(opens, F.concat(F.lit("["), at["alt"], F.lit("]"))).otherwise(blank))
        if links:
            out = out.when((tag == "a") & at["href"].isNotNull(), F.when(opens, blank).otherwise(F.concat(F.lit(" ("), U.resolve(base, at["href"]), F.lit(")"))))
        cell = F.when(opens & ~first_cell, " | ").otherwise(blank)
        row_end = blank
    return (out.when(tag == "li", F.when(opens, F.concat(F.lit("\n"), indent, bullet)).otherwise(blank))
            .when(tag.isin("ul", "ol"), F.when(_under(n, lists) > 0, blank).otherwise("\n\n"))
            .when(tag == "tr", F.when(opens, "\n").otherwise(row_end)).when(tag.isin("td", "th"), cell)
            .when(tag.isin("caption"), "\n\n").when(tag.isin(*BLOCKS), "\n\n").otherwise(blank))


def render(body_text: Column, nodes: Column, base: Column, markdown: bool = True, links: bool = True, images: bool = True,
           emphasis: bool = True, drop: str = "title,head") -> Column:
    """Rendered page. `drop` names elements left out with their text; hidden ones are always left out."""
    def run(nd, gone, lists, pres):
        kept = F.filter(nd, lambda n: ~F.exists(gone, lambda g: (n["id"] >= g["id"]) & (n["id"] <= g["last"])))
        ev = F.array_sort(F.flatten(F.transform(kept, lambda n: F.array(
            F.struct(n["open"].alias("seq"), n["t0"].alias("off"), F.lit(True).alias("open"), F.lit(False).alias("gone"), n["id"].alias("id")),
            F.struct(n["close"].alias("seq"), n["t1"].alias("off"), F.lit(False).alias("open"), F.lit(False).alias("gone"), n["id"].alias("id"))))))
        cuts = F.transform(gone, lambda g: F.struct(g["open"].alias("seq"), g["t1"].alias("off"), F.lit(True).alias("open"), F.lit(True).alias("gone"), g["id"].alias("id")))
        # a dropped element becomes one event that jumps over its text; the text before it ends at its start
        allev = F.array_sort(F.concat(ev, cuts))

        def piece(all_, x, i):
            nxt = F.get(all_, i + 1)
            stop = F.coalesce(F.when(nxt["gone"], F.get(nd, nxt["id"])["t0"]).otherwise(nxt["off"]), F.length(body_text))
            raw = F.substring(body_text, x["off"] + 1, F.greatest(stop - x["off"], F.lit(0)))
            node = F.get(nd, x["id"])
            in_pre = ((node["tag"] == "pre") & x["open"]) | (_under(node, pres) > 0)
            flat = F.regexp_replace(raw, r"\s+", " ")
            after_block = node["tag"].isin(*BLOCKS, "li", "tr", "td", "th", "br", "thead", "tbody", "body", "html", "head", "caption")
            txt = F.when(in_pre, raw).when(after_block, F.ltrim(flat)).otherwise(flat)
            mark = _marker(F.struct(node.alias("n"), x["open"].alias("open")), nd, lists, pres, base, markdown, links, images, emphasis)
            return F.concat(F.when(x["gone"], "").otherwise(mark), txt)

        return let(allev, lambda a: F.array_join(F.transform(a, lambda x, i: piece(a, x, i)), ""))

    hidden = ",".join(p for p in ("[hidden]", drop) if p)
    out = let(nodes, lambda nd: let(elements(nd, hidden), lambda gone: let(elements(nd, "ul,ol"), lambda ls: let(
        elements(nd, "pre"), lambda ps: run(nd, F.filter(gone, lambda g: ~F.exists(gone, lambda o: (o["id"] < g["id"]) & (o["last"] >= g["id"]))), ls, ps)))))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def citations(md: Column) -> Column:
    """struct<text, refs>: links become text[n] with one number per address; refs lists them in order."""
    def build(m):
        def with_refs(texts, urls, nums):
            body = F.array_join(F.transform(F.split(m, LINK), lambda g, i: F.concat(g, F.when(
                i < F.size(urls), F.concat(F.get(texts, i), F.lit("["), F.array_position(nums, F.get(urls, i)).cast("string"), F.lit("]"))).otherwise(""))), "")
            refs = F.transform(nums, lambda u, i: F.struct((i + 1).alias("n"), F.coalesce(F.nullif(F.get(
                texts, (F.array_position(urls, u) - 1).cast("int")), F.lit("")), F.lit("Link")).alias("title"), u.alias("url")))
            return F.struct(body.alias("text"), refs.alias("refs"))

        return let(F.regexp_extract_all(m, F.lit(LINK), 1), lambda t: let(F.regexp_extract_all(m, F.lit(LINK), 2), lambda u: let(
            F.array_distinct(u), lambda d: with_refs(t, u, d))))

    return let(md, build)


def references_markdown(refs: Column) -> Column:
    lines = F.transform(refs, lambda r: F.concat(r["n"].cast("string"), F.lit(". ["), r["title"], F.lit("]("), r["url"], F.lit(")")))
    return F.when(F.size(refs) > 0, F.concat(F.lit("## References\n"), F.array_join(lines, "\n"))).otherwise("")
