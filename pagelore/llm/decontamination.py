"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur with k = floor(rate * n) edits. It is split into k + 1 pieces: k edits leave one of
them untouched, so every occurrence shows an exact piece. All pieces of a block of items are looked for at once
(Aho-Corasick); a hit is verified by Myers' bit-parallel distance, first in the node of a binary tree over the pieces
that holds the hit and one neighbour (two pieces: one edit), then in the node above, up to the item. A node of m pieces
that holds at most m - 1 edits has a child that does the same, so no occurrence is lost, and a chance hit ends after
some twenty characters.

Items are the query set: they are fetched in blocks of at most BLOCK_CHARS characters, and each block runs over all
documents once, without a shuffle; a document is judged on its own. Both sides are compared in lower case with every
run of blanks as one blank.

Cases: null or blank items match nothing; null and empty texts hold nothing; equal items are found each; of several
places of an item in a text the one of least distance is given, ties go to the first; repeated documents are judged one
by one; empty tables give no matches; other columns of the documents pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.1
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id:long,distance:int,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """Myers' bit vectors of one string; Python integers hold any length in one word."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.of: dict[str, int] = {}
        for k, c in enumerate(text):
            self.of[c] = self.of.get(c, 0) | 1 << k

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the substring of `text` nearest to the pattern, the first of the nearest; None above `most`."""
        up, down, score, found = self.full, 0, self.size, None
        of, full, top = self.of, self.full, self.top
        for at, c in enumerate(text, 1):
            eq = of.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            plus = down | ~(xh | up) & full
            minus = up & xh
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1  # the row above stays 0: a match may begin anywhere
            minus = minus << 1
            up = (minus | ~(xv | plus)) & full
            down = plus & xv & full
            if score <= most:
                found, most = (score, at), score - 1
                if not score:
                    break
        return found


@dataclass
class Node:
    at: int  # place of the node's text in the item
    end: int
    leaves: int
    up: Node | None
    pattern: Pattern | None = None


class Item:
    """An item's pieces and the tree over them."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text = item_id, text
        pieces = int(len(text) * rate) + 1
        cut = [len(text) * k // pieces for k in range(pieces + 1)]
        self.leaves: list[Node] = []
        self._grow(cut, 0, pieces, None)

    def _grow(self, cut: list[int], a: int, b: int, up: Node | None) -> None:
        node = Node(cut[a], cut[b], b - a, up)
        if b - a == 1:
            self.leaves.append(node)
        else:
            mid = (a + b) // 2
            self._grow(cut, a, mid, node)
            self._grow(cut, mid, b, node)

    def verify(self, text: str, at: int, leaf: Node) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item near a leaf found at `at`."""
        node, low, found = leaf, at, None
        while node.up is not None:
            node = node.up
            slack = node.leaves - 1
            low = max(0, at - (leaf.at - node.at) - slack)
            high = at + (node.end - leaf.at) + slack
            if node.pattern is None:
                node.pattern = Pattern(self.text[node.at:node.end])
            found = node.pattern.best(text[low:high], slack)
            if found is None:
                return None
        if leaf.up is None:
            return 0, at, at + len(self.text)
        distance, end = found
        end += low
        back = Pattern(self.text[::-1]).best(text[max(0, end - len(self.text) - distance):end][::-1], distance)
        # the reversed pattern must be met from the end on; its nearest end is the start of the match
        return distance, end - (back[1] if back else len(self.text)), end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.search = ahocorasick.Automaton()
        holders: dict[str, list[tuple[Item, Node]]] = {}
        for item_id, text in items:
            if text:
                item = Item(item_id, text, rate)
                for leaf in item.leaves:
                    holders.setdefault(text[leaf.at:leaf.end], []).append((item, leaf))
        for piece, held in holders.items():
            self.search.add_word(piece, (len(piece), held))
        self.any = bool(holders)
        if self.any:
            self.search.make_automaton()

    def matches(self, text: str) -> list[dict]:
        if not self.any or not text:
            return []
        best: dict[int, tuple[int, int, int, int | None]] = {}
        done: set[tuple[int, int, int]] = set()
        exact: set[tuple[int, int]] = set()
        for last, (size, held) in self.search.iter(text):
            at = last + 1 - size
            for item, leaf in held:
                key = id(item)
                if (key, at - leaf.at) in exact:  # a piece of an occurrence without edits
                    continue
                found = item.verify(text, at, leaf)
                if found is not None:
                    if not found[0]:
                        exact.add((key, found[1]))
                    if (key, *found[:2]) not in done:
                        done.add((key, *found[:2]))
                        old = best.get(key)
                        if old is None or found < old[:3]:
                            best[key] = (*found, item.item_id)
        return [{"item_id": i, "distance": d, "start": s, "end": e} for d, s, e, i in sorted(best.values(), key=lambda x: (x[3] is None, x[3] or 0, x[1]))]


_MATCHERS: dict[str, Matcher] = {}  # of the last block, kept by a Python worker for its next batches


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).orderBy(F.col(id_col)).toLocalIterator():
        block.append((item_id, normal(text)))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _find(shared):
    name = uuid.uuid4().hex

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        if name not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[name] = Matcher(*shared.value)
        m = _MATCHERS[name]
        return pa.array([m.matches(normal(t.as_py())) for t in texts], _ARROW)

    return run


def matches(docs: DataFrame, items: DataFrame, text: Column, rate: float = RATE, item_id: str = "item_id", item_text: str = "text") -> Column:
    """Array of the items that a text holds, as a column of `docs`."""
    found = []
    for block in _blocks(items, item_id, item_text):
        found.append(_find(docs.sparkSession.sparkContext.broadcast((block, rate)))(text))  # at most BLOCK_CHARS characters
    return F.concat(*found) if found else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): the documents that hold an item; places count the normalised characters."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return d.select("doc_id", F.inline(matches(d, items, d["t"], rate)))


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item."""
    return docs.where(F.size(matches(docs, items, docs[text_col], rate)) == 0)
