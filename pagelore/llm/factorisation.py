"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The last term is the sum of all pairwise interactions <v_i, v_j> x_i x_j in time linear in the features of a text.
Features: words hashed to slots (term counts of length one), structure statistics in bins (length, word length, shares
of distinct words, repeats, capitals, digits, symbols, bars, marks, lines), and the table's n_chars as metadata. Labels,
language, source and document id are never features.

Training takes labelled rows whose crc32(id) mod 3 is not 1, at most `max_rows` of them in seeded hash order (a bounded,
documented sample: MAX_ROWS); their features, not their texts, come to the driver, where a few epochs of AdaGrad fit
the weights. Scoring reads every row: Arrow batches on the executors with the weights as a broadcast variable of fixed
size (DIMENSIONS x (RANK + 1) floats).

Cases: a null text scores as the empty one; a null n_chars is a bin of its own; a null id is never held out and has no
label; several labels of an id count by their mean; without labelled rows every score is 0.5; repeated rows score
alike; other columns pass through.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 12_000
DIMENSIONS = 1 << 16
RANK = 8
BINS = 32
STATISTICS = 13
FIRST_WORD = STATISTICS * BINS

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>@^~=\\{}[]"
_MARKS = b"!?"
_POINTS = b".,;:"


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    n, size = len(words), len(data)

    def share(chars: bytes, of: int) -> float:
        return (size - len(data.translate(None, chars))) / of if of else 0.0

    def bin_(x: float) -> int:
        return min(BINS - 1, int(x))

    per_char, per_word = max(size, 1), max(n, 1)
    stats = (
        bin_(np.log2(n + 1) * 1.5),
        bin_(2 * (size - n) / per_word) if n else 0,
        bin_(20 * len(counts) / per_word) if n else 0,
        bin_(25 * sum(map(operator.eq, words, words[1:])) / per_word),
        bin_(30 * share(_UPPER, per_char)),
        bin_(60 * share(_DIGITS, per_char)),
        bin_(10 * share(_SYMBOLS, per_word)),
        bin_(20 * share(b"|", per_word)),
        bin_(10 * share(_MARKS, per_word)),
        bin_(30 * share(_POINTS, per_word)),
        bin_(100 * share(b"\n", per_word)),
        bin_(20 * max(counts.values(), default=0) / per_word),
        BINS - 1 if n_chars is None else min(BINS - 2, int(np.log2(max(n_chars, 0) + 1) * 1.5)),
    )
    slots = np.array([k * BINS + b for k, b in enumerate(stats)], dtype=np.int32)
    values = np.full(STATISTICS, STATISTICS ** -0.5, dtype=np.float32)
    if counts:
        crc = zlib.crc32
        hashed = np.fromiter(map(crc, counts), dtype=np.int64, count=len(counts)) % (DIMENSIONS - FIRST_WORD) + FIRST_WORD
        tf = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        slots = np.concatenate([slots, hashed.astype(np.int32)])
        values = np.concatenate([values, tf / np.sqrt((tf * tf).sum())])
    return slots, values


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # DIMENSIONS
    factors: np.ndarray  # DIMENSIONS x RANK

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        xv = self.factors[slots] * values[:, None]
        return float(self.bias + self.linear[slots] @ values + 0.5 * ((xv.sum(0) ** 2).sum() - (xv * xv).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.1, decay: float = 1e-4,
        seed: int = 7) -> Model:
    """AdaGrad on the logistic loss; only the slots of a batch are touched."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(DIMENSIONS, np.float32), rng.normal(0, 0.05, (DIMENSIONS, RANK)).astype(np.float32)
    bias, seen_bias = 0.0, 1e-6
    seen_linear, seen_factors = np.full(DIMENSIONS, 1e-6, np.float32), np.full((DIMENSIONS, RANK), 1e-6, np.float32)
    model = Model(bias, linear, factors)
    if not len(rows):
        model.factors[:] = 0
        return model
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            slots = np.concatenate([rows[k][0] for k in some])
            x = np.concatenate([rows[k][1] for k in some])
            starts = np.cumsum([0, *(len(rows[k][0]) for k in some[:-1])])
            of = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            v = factors[slots]
            xv = v * x[:, None]
            sums = np.add.reduceat(xv, starts, axis=0)
            pair = 0.5 * ((sums ** 2).sum(1) - np.add.reduceat((xv * xv).sum(1), starts))
            margin = bias + np.add.reduceat(linear[slots] * x, starts) + pair
            wrong = (1 / (1 + np.exp(-margin)) - labels[some]).astype(np.float32)
            by_slot, place = np.unique(slots, return_inverse=True)
            g = wrong[of] * x
            g_linear = np.bincount(place, g, len(by_slot)).astype(np.float32) + decay * linear[by_slot]
            each = g[:, None] * (sums[of] - xv)
            g_factors = np.stack([np.bincount(place, each[:, f], len(by_slot)) for f in range(RANK)], axis=1).astype(np.float32) + decay * factors[by_slot]
            seen_linear[by_slot] += g_linear ** 2
            seen_factors[by_slot] += g_factors ** 2
            linear[by_slot] -= rate * g_linear / np.sqrt(seen_linear[by_slot])
            factors[by_slot] -= rate * 0.3 * g_factors / np.sqrt(seen_factors[by_slot])
            seen_bias += float(wrong.sum()) ** 2
            bias -= rate * float(wrong.sum()) / seen_bias ** 0.5
    model.bias = bias
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Model:
    """Fit on `docs` (doc_id, text, n_chars) with `labels` (doc_id, quality)."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.arrow_udf("struct<slots:array<int>,values:array<float>>")
    def extract(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        each = [features(t.as_py(), c.as_py()) for t, c in zip(text, n_chars, strict=True)]
        return pa.StructArray.from_arrays([
            pa.array([s for s, _ in each], pa.list_(pa.int32())), pa.array([v for _, v in each], pa.list_(pa.float32()))], ["slots", "values"])

    # the sample is bounded by max_rows short rows, so it may be broadcast
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(some), "doc_id")
    got = rows.select("doc_id", "y", extract("text", "n_chars").alias("x")).toArrow().combine_chunks().sort_by("doc_id")
    x = got.column("x").combine_chunks() if len(got) else None
    each = []
    for k in range(len(got)):
        r = x[k]
        each.append((r["slots"].values.to_numpy(), r["values"].values.to_numpy()))
    return fit(each, got.column("y").to_numpy().astype(np.float32) if len(got) else np.zeros(0, np.float32), **options)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of `docs` and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    @F.arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        margins = np.array([m.margin(*features(t.as_py(), c.as_py())) for t, c in zip(text, n_chars, strict=True)], dtype=float)
        return pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))), pa.float64())

    return docs.withColumn(name, score(docs["text"], docs["n_chars"].cast("long")))


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    d = docs.select("doc_id", "text", "n_chars")
    s = with_score(d, train(d, labels, max_rows)).drop("text")
    return s.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
