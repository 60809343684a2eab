"""Clusters of similar blocks within pages."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

PAGES_AT_ONCE = 32


def block_vectors(texts: dict[int, str], max_terms: int | None = None) -> dict[int, list[tuple[int, str, float]]]:
    """Unit TF-IDF vectors of the blocks of a page as (df, term, weight), rare terms first; terms are single words and pairs of neighbours.

    idf is ln((1 + n) / (1 + df)) + 1 over the page's blocks. `max_terms` keeps the most frequent terms of the page alone.
    """
    tf = {}
    for block, text in texts.items():
        w = [x for x in text.split(" ") if x]
        tf[block] = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])
    df = Counter(t for c in tf.values() for t in c)
    if max_terms is not None:
        times = Counter()
        for c in tf.values():
            times.update(c)
        kept = set(sorted(times, key=lambda t: (-times[t], t))[:max_terms])
        tf = {b: {t: k for t, k in c.items() if t in kept} for b, c in tf.items()}
    out = {}
    for block, c in tf.items():
        v = sorted((df[t], t, k * (log((1 + len(texts)) / (1 + df[t])) + 1)) for t, k in c.items())
        norm = sqrt(sum(x * x for _, _, x in v))
        out[block] = [(n, t, x / norm) for n, t, x in v]
    return out


def linked_blocks(vectors: dict[int, list[tuple[int, str, float]]], min_similarity: float) -> dict[int, int]:
    """Block -> least block it is linked with by cosines of `min_similarity` or more; exact.

    A pair shares a term among the first of either block, up to which their squared weights reach 1 - t^2: what lies behind
    is shorter than t. So only these rare terms bring pairs together; blocks that are linked already are not compared.
    """
    least = {b: b for b in vectors}

    def find(b: int) -> int:
        while least[b] != b:
            least[b] = b = least[least[b]]
        return b

    index = defaultdict(list)
    for block, v in vectors.items():
        before = 0.0
        for _, t, x in v:
            if before > 1 - min_similarity ** 2 + 1e-9:
                break
            index[t].append(block)
            before += x * x
    weights = {b: {t: x for _, t, x in v} for b, v in vectors.items()}
    seen = set()
    for together in index.values():
        for a, b in combinations(together, 2):
            x, y = find(a), find(b)
            if x == y or (a, b) in seen:
                continue
            seen.add((a, b))
            u, v = weights[a], weights[b]
            if round(sum(w * v.get(t, 0.0) for t, w in u.items()), 9) >= min_similarity:
                least[max(x, y)] = min(x, y)
    return {b: find(b) for b in vectors}


def clusters_of(blocks: list[dict], min_similarity: float, min_words: int, k: int, max_terms: int | None) -> list[dict]:
    """The k clusters with most words of one page, from its blocks (block, text, words); text is lower-cased and squeezed."""
    first = {}
    for b in sorted(blocks, key=lambda b: b["block"]):
        if b["text"]:
            first.setdefault(b["text"], b["block"])
    linked = linked_blocks(block_vectors({b: text for text, b in first.items()}, max_terms), min_similarity)
    sizes = defaultdict(lambda: [0, 0])
    for b in blocks:
        c = sizes[linked[first[b["text"]]] if b["text"] else b["block"]]
        c[0] += 1
        c[1] += b["words"] or 0
    best = sorted((-words, c, n) for c, (n, words) in sizes.items() if words >= min_words)[:k]
    return [{"cluster": c, "n_blocks": n, "words": -words, "rank": i + 1} for i, (words, c, n) in enumerate(best)]


CLUSTERS = T.ArrayType(T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n_blocks", T.LongType()),
                                     T.StructField("words", T.LongType()), T.StructField("rank", T.IntegerType())]))
_CLUSTERS = pa.list_(pa.struct([("cluster", pa.int32()), ("n_blocks", pa.int64()), ("words", pa.int64()), ("rank", pa.int32())]))


def page_clusters(blocks: DataFrame, min_similarity: float = 0.8, min_words: int = 10, k: int = 3, max_terms: int | None = None,
                  query: str | None = None, least_overlap: float = 0.3) -> DataFrame:
    """(page_id, cluster, n_blocks, words, rank): the k clusters with most words of each page, named by their first block.

    Blocks are linked by the cosine of their TF-IDF vectors and joined by components. The texts of a page are shuffled once, to
    its row; terms and pairs of blocks are made and used there and never leave it. Equal texts of a page are one block of
    the search, so a page that repeats a text a thousand times makes no pairs of it. With a `query`, only blocks whose words
    overlap with it (Jaccard) by `least_overlap` take part.

    Cases: a block without words is a cluster of its own; null texts count as empty; pages without blocks give no rows.
    """
    b = blocks.select("page_id", "block", F.lower(X.squeeze(F.coalesce("text", F.lit("")))).alias("text"), "words")
    if query is not None:
        asked = X.literal_set(sorted(set(query.lower().split())))
        mine = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
        b = b.where(F.size(F.array_intersect(mine, asked)) >= least_overlap * F.size(F.array_union(mine, asked)))
    pages = b.groupBy("page_id").agg(F.collect_list(F.struct("block", "text", "words")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time: their texts as Python objects take many times the room of the Arrow array
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                found = [clusters_of(x, min_similarity, min_words, k, max_terms) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _CLUSTERS)], names=["page_id", "clusters"])

    out = pages.mapInArrow(run, T.StructType([pages.schema["page_id"], T.StructField("clusters", CLUSTERS)]))
    return out.select("page_id", F.explode("clusters").alias("c")).select("page_id", "c.*")
