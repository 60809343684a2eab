"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

Terms of a text are its words, lower-cased and without the marks around them, and the beginnings of longer words, each
also as "twice or more", "four times or more" and so on, since a cosine does not see how often. The vocabulary is those terms that labelled rows use more in toxic texts than chance explains (log-likelihood ratio of at
least `LEAST_G2`), so that what many texts have in common by topic or language does not decide who is near.

* One pass over all documents writes their term counts over the vocabulary; document frequencies come from that table,
  and it is scored, so whole texts are cut into words once.
* Examples are at most `max_rows` labelled rows whose crc32(id) mod 3 is not 1, in seeded hash order (a bounded,
  documented sample: MAX_ROWS). Equal vectors are one entry with their rows and votes. Entries are sorted by their terms and cut
  into blocks; the index keeps, for every term and block, the postings and the largest weight.
* A text bounds every block by the sum of its weights times the largest weights, visits blocks by falling bound and
  stops when no bound reaches its k-th best similarity: the k nearest are exact, ties go to the entry first in order.
* A neighbour votes with its share of toxic rows and the weight 1 / (0.1 + 1 - similarity); the share of all examples
  votes from distance 1. A logistic curve, fitted on votes from which each example's own row was taken away, makes
  scores out of votes.
* The evidence of a score is its three nearest entries: the smallest example id, similarity and toxic share.

Cases: a null or empty text and one without a term of the vocabulary has the empty vector, whose neighbour is the
examples without terms, at similarity 1; a null id is never held out and has no label; rows that repeat an id are
all scored, and as an example an id counts once, with the least of its vectors; ids with several labels take their
mean, ties count as toxic; without any label every score is 0.5, without a toxic one it is the share of toxic rows by
the curve; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .factorisation import fold

MAX_ROWS = 12_000
MAX_TERMS = 4096
LEAST_G2 = 30.0
NEIGHBOURS = 15
BLOCK = 64
AT_ONCE = 8  # blocks
ROOM = 400_000
BEGINNINGS = (4, 5, 7)
LEVELS = (2, 4, 8)
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~^=+`@"


def terms_of(word: str) -> list[str]:
    """The terms of one word: itself, and its beginnings, which end in a star."""
    w = word.lower().strip(MARKS)
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) >= n)] if w else []


def leveled(counts: Counter) -> Counter:
    """Every term, and once more for every level that its count reaches."""
    out = Counter(counts)
    for t, n in counts.items():
        if n >= LEVELS[0]:
            out.update({f"{t} x{level}": n for level in LEVELS if n >= level})
    return out


def all_terms(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for t in terms_of(word):
            out[t] += n
    return leveled(out)


class Terms:
    """Numbers of the vocabulary's terms in a text; words are looked at once per worker."""

    def __init__(self, vocabulary: list[str]):
        self.number, self.known = {t: k for k, t in enumerate(vocabulary)}, {}
        self.bare = {t.split(" ")[0] for t in vocabulary}

    def counts(self, text: str | None) -> Counter:
        """Term number -> how often."""
        out: Counter = Counter()
        known = self.known
        for word, n in Counter((text or "").split()).items():
            mine = known.get(word)
            if mine is None:
                if len(known) > ROOM:
                    known.clear()
                mine = known[word] = [t for t in terms_of(word) if t in self.bare]
            for t in mine:
                out[t] += n
        return Counter({self.number[t]: n for t, n in leveled(out).items() if t in self.number}) if out else out


def vocabulary(docs: DataFrame, known: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The terms that are more frequent in toxic rows of `known` (doc_id, y), the clearest `max_terms` of them, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update(all_terms(text.as_py()).keys())
            for y in (0, 1):
                yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen[y]), pa.string()), "y": pa.array([y] * len(seen[y]), pa.int32()), "n": pa.array(list(seen[y].values()), pa.int64())})

    rows = known.groupBy("y").count().collect()
    total = {r.y: r["count"] for r in rows}
    if len(total) < 2:
        return []
    counts = docs.join(F.broadcast(known), "doc_id").select("text", "y").mapInArrow(run, "term string, y int, n long")
    # an id may have several rows, but it counts as many examples as rows only up to the number of examples
    both = counts.groupBy("term").agg(*[F.least(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)), F.lit(total[y])).alias(f"n{y}") for y in (0, 1)])
    a, b = F.col("n1"), F.col("n0")
    share = (a + b) / (total[0] + total[1])

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    g2 = 2 * sum((part(n, share * of) + part(of - n, (1 - share) * of) for n, of in ((a, total[1]), (b, total[0]))), F.lit(0.0))
    chosen = both.where(a / total[1] > b / total[0]).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    return sorted(r.term for r in chosen.orderBy(F.col("g2").desc(), "term").limit(max_terms).select("term").collect())


def vectors(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, terms, tf) of every document, terms ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Terms(words)
        for b in batches:
            each = [sorted(t.counts(x.as_py()).items()) for x in b.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            flat = np.array([p for e in each for p in e], dtype=np.int32).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[:, k]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "terms", "tf"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_and_read(d.mapInArrow(run, "doc_id long, terms array<int>, tf array<int>"), "term_counts")


@dataclass
class Index:
    """Entries in blocks; postings sorted by (block, term)."""

    idf: np.ndarray
    rows: np.ndarray  # per entry
    toxic: np.ndarray
    names: np.ndarray  # smallest example id
    keys: np.ndarray  # block * terms + term, one per posting
    entry: np.ndarray
    weight: np.ndarray
    at: np.ndarray  # per term, where its blocks begin
    of_block: np.ndarray
    largest: np.ndarray
    blocks: int
    empty: int | None

    @classmethod
    def build(cls, idf: np.ndarray, entries: list[tuple[tuple[int, ...], tuple[int, ...], int, int, int]]) -> Index:
        """`entries`: (terms, tf, rows, toxic rows, smallest id), vectors distinct."""
        entries = sorted(entries)
        n = len(entries)
        terms = np.array([t for e in entries for t in e[0]], dtype=np.int64)
        of = np.repeat(np.arange(n), [len(e[0]) for e in entries])
        tf = np.array([x for e in entries for x in e[1]], dtype=float)
        w = (1 + np.log(tf)) * idf[terms]
        norm = np.sqrt(np.bincount(of, w * w, n))
        w = w / norm[of]
        key = of // BLOCK * max(1, len(idf)) + terms
        order = np.lexsort((of, key))
        key, of, w = key[order], of[order], w[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        top = np.maximum.reduceat(w, first) if len(w) else w
        term, block = key[first] % max(1, len(idf)), key[first] // max(1, len(idf))
        by_term = np.lexsort((block, term))
        at = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
        empty = next((k for k, e in enumerate(entries) if not e[0]), None)
        return cls(idf, np.array([e[2] for e in entries]), np.array([e[3] for e in entries]), np.array([e[4] for e in entries], dtype=object), key, of, w,
                   at, block[by_term], top[by_term], -(-n // BLOCK), empty)

    def weights(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, tf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, similarities) of the k nearest with a similarity above zero."""
        if not len(terms):
            return (np.zeros(0, np.int64), np.zeros(0)) if self.empty is None else (np.array([self.empty]), np.ones(1))
        q = self.weights(terms, tf)
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, q, strict=True):
            a, b = self.at[t], self.at[t + 1]
            bound[self.of_block[a:b]] += w * self.largest[a:b]
        order = np.argsort(-bound, kind="stable")
        order = order[:np.count_nonzero(bound)]
        best, sims = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), AT_ONCE):
            some = order[at:at + AT_ONCE]
            if len(sims) == k and bound[some[0]] < sims[-1] - 1e-9:
                break
            wanted = (some[:, None] * len(self.idf) + terms).ravel()
            a, b = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, side="right")
            length = b - a
            place = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
            mine, where = np.unique(self.entry[place], return_inverse=True)
            score = np.bincount(where, self.weight[place] * np.repeat(np.tile(q, len(some)), length), len(mine))
            best, sims = np.concatenate([best, mine]), np.concatenate([sims, np.round(score, 12)])
            top = np.lexsort((best, -sims))[:k]
            best, sims = best[top], sims[top]
        return best, sims

    def votes(self, entries: np.ndarray, sims: np.ndarray, own: tuple[int, int] | None = None, k: int = NEIGHBOURS) -> float:
        """Weighted share of toxic rows; `own` (entry, label) takes one row of an example away."""
        rows, toxic = self.rows[entries].astype(float), self.toxic[entries].astype(float)
        all_rows, all_toxic = float(self.rows.sum()), float(self.toxic.sum())
        if own is not None:
            me = entries == own[0]
            rows, toxic = rows - me, toxic - me * own[1]
            sims, toxic, rows = sims[rows > 0], toxic[rows > 0], rows[rows > 0]
            all_rows, all_toxic = all_rows - 1, all_toxic - own[1]
        w = 1 / (1.1 - np.minimum(sims[:k], 1.0))
        prior = all_toxic / all_rows if all_rows else 0.5
        return float((w @ (toxic[:k] / rows[:k]) + prior / 1.1) / (w.sum() + 1 / 1.1)) if len(w) else prior


def fit_curve(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b logit(vote)))), by Newton steps with a small penalty."""
    x = np.stack([np.ones(len(votes)), _logit(votes)], axis=1)
    beta = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (weight * (p - y)) + 1e-2 * (beta - [0.0, 1.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, k: int = NEIGHBOURS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document of `docs` (doc_id, text), by `labels` (doc_id, toxic)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = labelled.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = write_and_read(known, "examples")
    words = vocabulary(docs, known)
    counts = vectors(docs, words)
    n = counts.count()
    df = np.zeros(len(words))
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term
        df[r.t] = r["count"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # at most max_rows examples: one vector an id
    examples = counts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("terms", "tf")).alias("v"))
    entries = examples.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("toxic"), F.min("doc_id").alias("name")).collect()
    index = Index.build(idf, [(tuple(r.v.terms), tuple(r.v.tf), r.rows, r.toxic, r.name) for r in entries])
    shared = spark.sparkContext.broadcast(index)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = shared.value
        for b in batches:
            out = []
            for v, rows, toxic, name in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                near, sims = i.nearest(np.array(v["terms"].as_py(), dtype=np.int64), np.array(v["tf"].as_py(), dtype=float), k + 1)
                me = next((e for e in near.tolist() if i.names[e] == name), -1)
                out += [(i.votes(near, sims, (me, y), k), y, m) for y, m in ((1, toxic), (0, rows - toxic)) if m]
            yield pa.RecordBatch.from_pydict({"vote": pa.array([o[0] for o in out], pa.float64()), "y": pa.array([o[1] for o in out], pa.int32()), "n": pa.array([o[2] for o in out], pa.int64())})

    again = spark.createDataFrame(entries, "v struct<terms:array<int>,tf:array<int>>, rows long, toxic long, name long")
    own = again.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(own_votes, "vote double, y int, n long").toPandas()
    curve = fit_curve(own["vote"].to_numpy(float), own["y"].to_numpy(float), own["n"].to_numpy(float)) if len(own) else (0.0, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, done = shared.value, {}
        for b in batches:
            out = []
            for terms, tf in zip(b.column(1), b.column(2), strict=True):
                terms, tf = terms.values.to_numpy(), tf.values.to_numpy()
                key = terms.tobytes(), tf.tobytes()
                if key not in done:
                    if len(done) > ROOM // 16:
                        done.clear()
                    near, sims = i.nearest(terms.astype(np.int64), tf.astype(float), k)
                    vote = i.votes(near, sims, None, k)
                    score = float(1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * _logit(np.array(vote)), -40, 40))))
                    done[key] = score, [{"doc_id": i.names[e], "similarity": float(s), "toxic": float(i.toxic[e] / i.rows[e])} for e, s in zip(near[:3].tolist(), sims[:3], strict=True)]
                out.append(done[key])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], kind)], names=["doc_id", "score", "evidence"])

    s = counts.mapInArrow(scored, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:double>>")
    return s.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
