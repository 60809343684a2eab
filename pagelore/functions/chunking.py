"""Documents to chunks: array columns computed inside the row, so chunking never shuffles.

Folds run in the JVM through aggregate(). Fixed values are the default sizes of each strategy.
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

STRINGS = "array<string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _nonblank(arr: Column) -> Column:
    return F.filter(F.transform(arr, strip), lambda s: s != "")


def identity_chunks(c: Column) -> Column:
    return F.array(c)


def regex_chunks(c: Column, patterns=(r"\n\n", r"\n", r"\. "), max_length: int = 5000, min_length: int = 10) -> Column:
    """Each pattern in turn splits the pieces that are still too long."""
    def split_long(pattern):
        return lambda s: F.when(F.length(s) > max_length, _nonblank(F.split(s, pattern))).otherwise(F.array(s))

    arr = F.array(c)
    for p in patterns:
        arr = F.flatten(F.transform(arr, split_long(p)))
    return F.filter(arr, lambda s: F.length(strip(s)) >= min_length)


def _fold(arr: Column, joins, joined) -> Column:
    """Left fold that either extends the current piece or starts a new one. The accumulator keeps the
    finished pieces and the open one."""
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc, s):
        keep = acc["cur"].isNotNull() & joins(acc["cur"], s)
        return F.struct(
            F.when(acc["cur"].isNull() | keep, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(acc["cur"].isNull(), s).when(keep, joined(acc["cur"], s)).otherwise(s).alias("cur"))

    return F.aggregate(arr, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(
        F.concat(a["done"], F.array(a["cur"]))))


def _space(a, b):
    return F.concat(a, F.lit(" "), b)


def sentence_chunks(c: Column, min_length: int = 10, merge: bool = True) -> Column:
    """Sentences; one shorter than twice the minimum takes the next one in."""
    arr = _nonblank(F.split(c, X.SENTENCE_BOUNDARY))
    if merge:
        arr = _fold(arr, lambda cur, s: F.length(cur) < min_length * 2, _space)
    return F.filter(arr, lambda s: F.length(s) >= min_length)


def paragraph_chunks(c: Column, min_length: int = 50, max_length: int = 2000) -> Column:
    """Paragraphs; a long one becomes groups of sentences up to the limit."""
    def group(p):
        return _fold(sentence_chunks(p, min_length // 2), lambda cur, s: F.length(cur) + F.length(s) <= max_length, _space)

    arr = F.flatten(F.transform(_nonblank(F.split(c, r"\n\s*\n")), lambda p: F.when(
        F.length(p) > max_length, group(p)).otherwise(F.array(p))))
    return F.filter(arr, lambda p: F.length(p) >= min_length)


def fixed_chunks(c: Column, size: int = 1000, overlap: int = 100, drop_tail: bool = False) -> Column:
    """Character windows without regard to words. The definition emits a last piece that repeats only the
    overlap; drop_tail leaves it out."""
    step = size - overlap
    n = F.length(c)
    last = F.when(n <= size, F.lit(0)).otherwise(F.floor((n - 1) / step).cast("int"))
    arr = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(c, i * step + 1, F.lit(size))))
    if drop_tail:
        arr = F.when(n > size, F.filter(arr, lambda s, i: (i == 0) | (i * step + overlap < n))).otherwise(arr)
    return F.when(n <= size, F.array(c)).otherwise(F.filter(arr, lambda s: s != ""))


def cut_at_words(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end at the last blank before the limit."""
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank if blank > at else end
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        at = max(end - overlap, at) if end - overlap > at else end
    return out


def word_chunks(size: int = 1000, overlap: int = 100):
    """Column function for the word-preserving fixed chunker (the cut depends on the cut before it)."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(v: pa.Array) -> pa.Array:
        return pa.array([None if s is None else cut_at_words(s, size, overlap) for s in v.to_pylist()], pa.list_(pa.string()))

    return chunks


TEXTS_AT_ONCE = 32
TOPIC_STOP = "the a an and or but in on at to for of with by".split()


def _vocabulary(s: Column) -> Column:
    toks = X.index_tokens(s)
    return F.filter(toks, lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOP))


def window_cosines(sentences: list[list[str]], window: int) -> list[float]:
    """Cosine of the word counts of neighbouring windows, in time linear in the words of the windows."""
    counts = [Counter(w for s in sentences[i:i + window] for w in s) for i in range(len(sentences) - window + 1)]
    square = [sum(x * x for x in c.values()) for c in counts]
    dots = (sum(x * b[w] for w, x in a.items()) for a, b in pairwise(counts))
    norms = (sqrt(p) * sqrt(q) for p, q in pairwise(square))
    return [dot / norm if norm > 0 else 0.0 for dot, norm in zip(dots, norms, strict=True)]


def coherence(sents: Column, window: int = 3) -> Column:
    """Cosine of the word counts of neighbouring windows of `window` sentences. Not for use inside a lambda: the counts are
    taken in an Arrow function."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def cosines(v: pa.Array) -> pa.Array:
        # a few texts at a time: their words as Python objects take many times the room of the Arrow array
        rows = (s for i in range(0, len(v), TEXTS_AT_ONCE) for s in v.slice(i, TEXTS_AT_ONCE).to_pylist())
        return pa.array([[] if s is None or len(s) <= window else window_cosines(s, window) for s in rows], pa.list_(pa.float64()))

    return cosines(F.transform(sents, _vocabulary))


def topic_boundaries(sim: Column, n: Column, window: int = 3, threshold: float = 0.3) -> Column:
    """Sentence index after each local minimum below the threshold, then the end."""
    low = F.filter(F.transform(sim, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (
        (x["i"] >= 1) & (x["i"] < F.size(sim) - 1) & (x["s"] < threshold)
        & (x["s"] < F.get(sim, x["i"] - 1)) & (x["s"] < F.get(sim, x["i"] + 1))))
    cuts = F.transform(low, lambda x: x["i"] + window)
    return F.concat(F.when(n > window * 2, cuts).otherwise(F.array().cast("array<int>")), F.array(n))


def topic_chunks(c: Column, window: int = 3, min_length: int = 100) -> Column:
    """Chunks between the boundaries; a small one joins the chunk before it."""
    def pieces(sents, cuts):
        start = lambda i: F.coalesce(F.get(cuts, i - 1), F.lit(0))
        return F.transform(cuts, lambda b, i: F.array_join(F.slice(sents, start(i) + 1, b - start(i)), " "))

    def make(both):
        sents = both["sents"]
        cuts = topic_boundaries(both["sim"], F.size(sents), window)
        merged = _fold(X.let(cuts, lambda k: pieces(sents, k)), lambda cur, s: F.length(s) < min_length, _space)
        return F.when(F.size(sents) <= window, F.array(c)).otherwise(merged)

    sents = sentence_chunks(c, 20)
    return F.when(F.trim(c) == "", F.array().cast(STRINGS)).otherwise(X.let(F.struct(sents.alias("sents"), coherence(sents, window).alias("sim")), make))


def merge_small(arr: Column, target: int = 1000, max_size: int = 2000) -> Column:
    return _fold(arr, lambda cur, s: (F.length(cur) < target) & (F.length(s) < target)
                 & (F.length(cur) + F.length(s) + 1 <= max_size), _space)


def hybrid_chunks(c: Column, primary=None, target: int = 1000, max_size: int = 2000, min_size: int = 100) -> Column:
    """Paragraphs (or another first split); too large ones by sentences and then by size; small neighbours merged."""
    first = primary(c) if primary is not None else paragraph_chunks(c, min_size, max_size)
    # a sentence still over the limit is cut by size; cuts fall at words, so only such sentences leave the JVM
    def refine(p):
        sub = sentence_chunks(p, min_size // 4)
        return F.flatten(F.transform(sub, lambda s: F.when(
            F.length(s) > max_size, fixed_chunks(s, target, target // 10)).otherwise(F.array(s))))

    refined = F.flatten(F.transform(first, lambda p: F.when(F.length(p) > max_size, refine(p)).otherwise(F.array(p))))
    return merge_small(refined, target, max_size)


def token_chunks(c: Column, max_tokens: int = 500, overlap_tokens: int = 50) -> Column:
    """Fixed chunks sized by tokens, four characters each."""
    return fixed_chunks(c, max_tokens * 4, overlap_tokens * 4)
