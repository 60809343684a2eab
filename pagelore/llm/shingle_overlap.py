"""Near-duplicates by the overlap of word shingles: every pair whose Jaccard similarity is 0.8 or more, none by chance.

* A text is the set of its word shingles, as 64-bit hashes in one order for all texts. Of n shingles two texts with
  similarity 0.8 share at least ceil(0.8 n), so the first p = n - ceil(0.8 n) + 1 of both hold a common one (prefix
  filter). Unlike bits of a SimHash, which at 0.8 differ by any number, this loses no pair.
* Rows with the same set are one node.
* First comes the search of op4 (`simhash`): fingerprints of the sets that differ by RADIUS bits at most, by the generalised
  pigeonhole. It links most close copies before shingles are compared at all. Pairs further apart are left to the filter.
* The order is by hash, but shingles that occur three times or more in one of `SAMPLE_OF` texts (all, if these are few) come
  last, the more frequent the later: passages that many texts quote do not bring these together, at any size of the input. The
  order steers the cost alone, every order finds all pairs.
* The sets that share a prefix shingle are a cell. Large cells are first compared with two of their sets as well, so that a
  large group of copies does not meet pair by pair; then all pairs that no verified link joins yet are counted over
  all cells, large cells in blocks. Of two prefixes that share c shingles, the last of them at places i and j, the sets
  share c + min(n_a - i, n_b - j) at most, and what the prefix that ends first leaves open at most; most pairs end there.
* A candidate is a link only if the whole sets overlap by 0.8.
* Every table of the search is deleted as soon as the groups are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..session import Scratch, free_name, write_and_read
from . import simhash
from .simhash import SEED, components

WIDTH = 5
RADIUS = 3
HOT = 64
MOST_HOT = 1 << 18
BLOCK = 256
SAMPLE_OF = 16
SAMPLE_LEAST = 2048


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words than `width` are one shingle, no words none."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    all_of = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((digest(s, SEED) for s in all_of), dtype=np.uint64).view(np.int64))


def _prefix(h: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The n - ceil(0.8 n) + 1 first shingles, hot ones last by their rank, and the share of hot ones in thousandths."""
    n, usual = len(h), 0
    p = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        late = hot[at] == h
        usual = int(1000 * late.mean())
        h = np.concatenate([h[~late], h[late][np.argsort(rank[at[late]], kind="stable")]])
    return h[:p], usual


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def _sets(docs: DataFrame, hot: np.ndarray | None, rank: np.ndarray | None = None) -> DataFrame:
    """(doc_id, digest, fp, n, usual, sim, h): digest of the text, digest and size of its set of shingles, the share of hot ones in it, the
    set's SimHash fingerprint and its prefix, or without `hot` no fingerprint and the set."""
    shared = None if hot is None else docs.sparkSession.sparkContext.broadcast((hot, rank))  # MOST_HOT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded memory
                b = batch.slice(at, 256)
                sets = [shingles(v.as_py()) for v in b.column(1)]
                fp = np.array([digest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                cut = [(s, 0) for s in sets] if shared is None else [_prefix(s, *shared.value) for s in sets]
                sims = [None if shared is None else simhash.of_hashes(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), pa.array([u for _, u in cut], pa.int16()),
                    pa.array(sims, pa.int64()), _lists([h for h, _ in cut])], names=["doc_id", "digest", "fp", "n", "usual", "sim", "h"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"), F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long, n int, usual smallint, sim long, h array<long>")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, rank): what occurs three times or more among one of SAMPLE_OF different texts, rarest first, MOST_HOT at most."""
    texts = docs.select("doc_id", "text")
    many = docs.count()
    of = max(1, min(SAMPLE_OF, many // SAMPLE_LEAST))
    # by the text: copies are all in or all out, and their set is counted once
    some = _sets(texts.where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0), None).groupBy("fp").agg(F.any_value("h").alias("h"))
    seen = some.select(F.explode("h").alias("key")).groupBy("key").count().where("count > 2").orderBy(F.col("count").desc(), "key").limit(MOST_HOT).collect()
    hot = np.array([r[0] for r in seen], dtype=np.int64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def _cells(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, digest, fp, n, usual, sim, h), and the members (key, fp, n, usual, at, many) of every cell of two sets or more."""
    rows = scratch.write(_sets(docs, *_frequent(docs)), "prefixes")
    keys = rows.groupBy("fp").agg(*[F.any_value(c).alias(c) for c in ("n", "usual", "h")]).select("fp", "n", "usual", F.posexplode("h").alias("at", "key")).repartition("key")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return rows, scratch.write(keys.join(counts, "key").select("key", "fp", "n", "usual", "at", "many"), "cells")


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (a, b) those whose sets overlap by 0.8: 9 common >= 4 (n_a + n_b). Only texts of these pairs are read again."""
    fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    of = scratch.write(first.join(fps, "fp", "left_semi"), "wanted")
    wanted = of.select(F.col("first").alias("wanted")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = scratch.write(_sets(texts, None).join(of, "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "n", "h"), "sets")
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("h").alias("h_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"))
    common = F.size(F.array_intersect("h_a", "h_b"))
    return scratch.write(pairs.join(b, "b").join(a, "a").where(9 * common >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "verified")


def _sizes_allow() -> Column:
    return 5 * F.least("n", "n_p") >= 4 * F.greatest("n", "n_p")


def _by_fingerprint(first: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by the search of op4, each fingerprint by its least set."""
    of = scratch.write(first.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprints")
    sims = of.select(F.col("sim").alias("fp"))
    links = simhash.links(sims, simhash.plan(sims, RADIUS), RADIUS)
    a, b = (of.select(F.col("sim").alias(x), F.col("least").alias(f"fp_{x}")) for x in "ab")
    near = links.join(a, "a").join(b, "b").select("fp_a", "fp_b")
    equal = spread_join(first.select("fp", "sim"), of, ["sim"], salt_by=["fp"]).where("fp <> least").select(F.col("fp").alias("fp_a"), F.col("least").alias("fp_b"))
    return near.unionByName(equal).select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))


def _with_pivots(cells: DataFrame) -> DataFrame:
    """(a, b): every set of a large cell with two sets of it, one of them that with the most frequent shingles: of texts that
    are copies of one with changes here and there, it is the one without."""
    cells = cells.where(F.col("many") > HOT)
    me = F.struct("fp", "n")
    pivots = cells.groupBy("key").agg(F.array(F.max_by(me, F.struct("usual", "fp")), F.max_by(me, F.xxhash64("fp"))).alias("p"))
    both = cells.join(pivots, "key").select("fp", "n", F.explode("p").alias("p")).select("fp", "n", F.col("p.fp").alias("fp_p"), F.col("p.n").alias("n_p"))
    return both.where(_sizes_allow() & (F.col("fp") != F.col("fp_p"))).select(F.least("fp", "fp_p").alias("a"), F.greatest("fp", "fp_p").alias("b")).distinct()


def _across(cells: DataFrame, root: DataFrame) -> DataFrame:
    """(a, b): all pairs in different components that have prefix shingles enough in common."""
    cells = cells.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ends = cells.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = cells.join(ends, "key", "left_semi").withColumn("blocks", F.ceil(F.col("many") / BLOCK))
    right = left.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("fp").alias("fp_p"), F.col("n").alias("n_p"), F.col("at").alias("at_p"), F.col("root").alias("root_p"))
    both = left.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).join(right, ["key", "block"])
    both = both.where(_sizes_allow() & (F.col("root") != F.col("root_p")) & (F.col("fp") < F.col("fp_p")))
    need = F.floor((4 * (F.col("n") + F.col("n_p")) + 8) / 9)
    rest = F.floor((4 * F.greatest("n", "n_p") + 4) / 5) - 1
    # what is left of either set behind the last place that they share
    left_open = F.least(F.col("n") - F.col("i"), F.col("n_p") - F.col("j")) - 1
    seen = both.groupBy(F.col("fp").alias("a"), F.col("fp_p").alias("b"), "n", "n_p").agg(F.count(F.lit(1)).alias("common"), F.max("at").alias("i"), F.max("at_p").alias("j"))
    return seen.where(F.col("common") + F.least(rest, left_open) >= need).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, root): every row with the digest of its text, and its component over links of similarity 0.8 or more.

    Cases: null and blank texts have the same, empty set; rows with a null id are kept and link others; repeated rows
    stay repeated; an id may have several texts, each in the component of its own; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows, cells = _cells(docs, scratch)
    first = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.any_value("sim").alias("sim")), "distinct")
    close = _by_fingerprint(first, scratch).unionByName(_with_pivots(cells)).distinct()
    links = _verified(scratch.write(close, "pairs"), docs, first.select("fp", "first"), scratch)
    more = _verified(scratch.write(_across(cells, components(links, scratch)), "pairs"), docs, first.select("fp", "first"), scratch)
    root = components(links.unionByName(more), scratch)
    named = first.select("fp").join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    found = write_and_read(spread_join(rows.select("doc_id", "digest", "fp"), named, ["fp"], salt_by=["doc_id", "digest"]).select("doc_id", "digest", "fp", "root"), "groups")
    scratch.clear()
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id of the component, null if no row of it has one."""
    found = groups(docs)
    name = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(found, name, ["root"], salt_by=["doc_id", "digest"])
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays.

    Cases: rows without an id cannot name a group and stay; of rows that repeat an id and text one stays; an id with different
    texts goes or stays by the group of each text. All columns are kept, whatever their names.
    """
    found = groups(docs)
    row = F.struct("doc_id", "digest")  # a row goes by its id and its own text
    named = found.where("doc_id is not null")
    first = named.groupBy("root").agg(F.min(row).alias("first"))
    told = spread_join(named, first, ["root"], salt_by=["doc_id", "digest"]).select("doc_id", "digest", (row == F.col("first")).alias("stays"))
    told = told.groupBy("doc_id", "digest", "stays").agg(F.count(F.lit(1)).alias("times"))
    # written: by its size Spark sees whether the texts have to be shuffled at all
    gone = write_and_read(told.where("not stays or times > 1"), "gone")
    digest = free_name(docs, "digest")
    others, again = (gone.where(c).select("doc_id", F.col("digest").alias(digest)) for c in ("true", "stays"))
    with_digest = docs.withColumn(digest, F.xxhash64("text"))
    once = with_digest.join(others, ["doc_id", digest], "left_anti")
    repeated = with_digest.join(again, ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest])
    return once.unionByName(repeated).select(*docs.columns)
