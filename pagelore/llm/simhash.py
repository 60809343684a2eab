"""SimHash near-duplicates by generalised pigeonhole search.

Two fingerprints of 64 bits within `radius` bits are found as follows.

* Fingerprints are made distinct first: copies never meet each other again, their rows only carry the fingerprint.
* Correlated bits go into the same partition, so that what is skewed sits in few partitions. The correlations come
  from the bit counts and pair counts of all distinct fingerprints (64 x 64 numbers).
* For m partitions, thresholds t_1..t_m with sum `radius - m + 1` (each at least -1) lose no pair: were every
  partition's distance above its threshold, the whole distance would be above the radius. Dynamic programming picks
  the thresholds, and the m, of least cost: keys written plus candidates expected. The expectation uses pair
  distances within a sample of at most SAMPLE fingerprints; it steers the cost alone, every choice finds all pairs.
* A fingerprint writes its own key in each partition and the keys of all values within the threshold; two rows that
  share a key, one of them as its own key, are a candidate and are verified on all 64 bits.
* A key with many fingerprints is cut into blocks, and each pair of blocks is a cell of its own, so no cell grows
  with the data. Cells emit a spanning forest of the links found in them, never all pairs.

Components then spread the least fingerprint over the forests until nothing changes; each round is written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, write_and_read

BITS = 64
SAMPLE = 2048
BLOCK = 2048
SEED = 42


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, the highest bit first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)


def of_hashes(h: np.ndarray) -> int:
    """Fingerprint of a text whose shingles have these hashes: a bit is 1 if more than half of them set it. No hashes: zero."""
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 15):  # long texts: bounded memory
        votes += _votes(h[k:k + (1 << 15)])
    return int(np.packbits(votes * 2 > len(h)).view(">i8")[0])


def _fingerprint(text: str | None, width: int) -> int:
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and the six blanks split
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 1 << 15):  # long texts: bounded memory
        part = words[k:k + (1 << 15) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(part)]
        votes += _votes(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): majority bits of the XXH64 of the word shingles, repeats included. No words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([_fingerprint(v.as_py(), width) for v in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _unpack(fp: np.ndarray) -> np.ndarray:
    """Bits of signed 64-bit fingerprints, column b holding bit b."""
    return np.unpackbits(np.ascontiguousarray(fp.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            x = _unpack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.append(i * BITS + j, -1), pa.int32()), "n": pa.array(np.append(total[i, j], n).astype(np.int64), pa.int64())})

    rows = fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 2081 rows at most
    g, n = np.zeros((BITS, BITS)), 0
    for k, v in rows:
        if k < 0:
            n = v
        else:
            g[k // BITS, k % BITS] = g[k % BITS, k // BITS] = v
    return n, g


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of almost equal size; each takes in turn the free bit that is most correlated with those it has."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs(np.where(spread > 0, (together / max(n, 1) - np.outer(p, p)) / spread, 1.0))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: (corr[b, free].max(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda x: (corr[x, part].mean(), -x))
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up with the given sum and least cost; costs[i][t + 1] is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*chosen, t])
        best = nxt
    return best[total]


def _ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def plan(fps: DataFrame, radius: int = 3, key_cost: float = 1.0, pair_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """The partitions that are searched, as (bits, threshold)."""
    n, together = bit_counts(fps)
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    bits = _unpack(np.array([r[0] for r in some], dtype=np.int64)).astype(np.float32)
    i, j = np.triu_indices(len(bits), 1)
    best = None
    for m in range(1, radius + 2):
        if _ball(BITS // m, radius - m + 1) > 5000:
            continue
        parts, costs = group_bits(n, together, m), []
        for part in parts:
            x = bits[:, part]
            gram = x @ x.T
            d = (gram.diagonal()[:, None] + gram.diagonal()[None, :] - 2 * gram)[i, j]
            row = [0.0]
            for t in range(radius + 1):
                share = max(float((d <= t).mean()) if len(d) else 0.0, _ball(len(part), t) / 2.0 ** len(part))
                row.append(key_cost * n * _ball(len(part), t) + pair_cost * n * n / 2 * share)
            costs.append(row)
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]
    return best[1]


def _keys(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, own): the fingerprint's own key in every partition, and those within the threshold."""
    flips = []
    for bits, t in parts:
        flips.append(np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(bits)), k)], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            x = _unpack(fp).astype(np.int64)
            for p, (bits, _) in enumerate(parts):
                value = (x[:, bits] << np.arange(len(bits))).sum(1) | (p << 56)
                for mask in np.array_split(flips[p], max(1, len(flips[p]) // 64)):
                    keys = (value[:, None] ^ mask[None, :]).ravel()
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(keys, pa.int64()), "fp": pa.array(np.repeat(fp, len(mask)), pa.int64()),
                        "own": pa.array(np.tile(mask == 0, len(fp)))})

    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: every node with the least node of its component among these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links among rows of the same cell; rows come sorted by cell (key, i, j)."""

    def found(cell: np.ndarray, fp: np.ndarray, own: np.ndarray):
        left, right, held, at = [], [], 0, np.arange(len(fp))
        for d in range(1, len(fp)):
            at = at[:np.searchsorted(at, len(fp) - d)]
            at = at[(cell[at] == cell[at + d]).all(1)]
            if not len(at):
                break
            near = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= radius
            hit = at[near & (own[at] | own[at + d]) & (fp[at] != fp[at + d])]
            if len(hit):
                left.append(fp[hit])
                right.append(fp[hit + d])
                held += len(hit)
            if held > 1 << 20:
                a, b = _forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
        if held:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    kept = None
    for batch in batches:
        cell = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)], axis=1).astype(np.int64)
        rows = (cell, batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False))
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]).all(1)
        cut = int(np.argmax(same))  # the last cell may go on in the next batch
        yield from found(*(x[:cut] for x in rows))
        kept = tuple(x[cut:] for x in rows)
    if kept is not None:
        yield from found(*kept)


def links(fps: DataFrame, parts: list[tuple[list[int], int]], radius: int = 3) -> DataFrame:
    """(a, b): forests that connect the same fingerprints as all links within the radius."""
    keys = _keys(fps, parts)
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    cut = keys.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cut.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "own")
    return (cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
            .mapInArrow(lambda it: _links(it, radius), "a long, b long"))


def components(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): least node of the component for every node of `pairs` (a, b); runs until no label changes. The tables of
    earlier rounds are deleted; `scratch` takes note of the last."""
    spark = pairs.sparkSession
    links_of, rounds = Scratch(spark), Scratch(spark)
    both = links_of.write(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = rounds.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        now = Scratch(spark)
        new = now.write(step.join(up, "mid").select("node", "old", F.least("mid", "up").alias("root")), "labels")
        rounds.clear()
        rounds = now
        if new.where("root <> old").isEmpty():
            links_of.clear()
            if scratch is not None:
                scratch.paths += rounds.paths
            return new.select("node", "root")
        label = new.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable over links of at most `radius` bits.

    Cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than `width` are one
    shingle; rows with a null id are kept, link others, and are never a component's name (null if no row of it has
    an id); repeated rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    rows = write_and_read(fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = write_and_read(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    pairs = links(fps, plan(fps, radius), radius)
    root = components(pairs)
    member = fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    name = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = member.join(name, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
