"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's share of the budget goes with its weight, but a source is taken at most `max_epochs` times: what is above
is shared out again by weight among the others until none is above. A target of e times the source's size means
floor(e) whole repetitions of every document, and the rest from documents in seeded hash order up to the place
nearest to the target.

That place is found from sums by hash prefix: two hex digits more in each step, only the bucket in which the target
falls is looked into, so a source of any size ends in a few rows. No source is collected or sorted as a whole; what
is joined to the documents is one row per source, without a hint.

Cases: a null text has size 0; a null source is a source of its own, last in order; sources without words get target
0; rows equal in id and text are taken together; a null id is hashed as an empty string; an empty table gives no
rows; other columns pass through `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, free_name, write_and_read

WEIGHTS = (3, 1, 2)
PREFIX_STEPS = (2, 4, 6, 8)


def text_size(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Seeded place of a document in its source."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1)
    s = write_and_read(sizes.select("source", "source_size", w.cast("double").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "sources")
    total, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level, clamped = budget / weight if weight else 0.0, 0
    while True:  # each round clamps at least one source more, or is the last
        above = F.col("weight") * level > F.col("cap")
        n, filled, free = s.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (budget - filled) / free
    return s.select("source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target, whole, upto) from (source, size, key): every document is taken `whole` times, those
    with key <= upto once more."""
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    t = write_and_read(t.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")), "targets")
    # `before`: words of the source ahead of the prefix that is looked into
    open_ = t.where("rest > 0").select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for step in (*PREFIX_STEPS, 32):
        place = F.substring("key", 1, step)
        at = sized.select(F.col("source").alias("s"), "key", "size")
        inside = at.join(open_, at.s.eqNullSafe(open_.source) & F.startswith(at.key, open_.prefix))
        sums = inside.groupBy("source", "rest", "before", place.alias("prefix")).agg(F.sum("size").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("prefix"))
        run = sums.select("source", "rest", "prefix", "n", upto.alias("upto"))
        if step < 32:
            # the first bucket that reaches the rest; rounding may leave it just above all buckets, then the last one
            open_ = write_and_read(run.groupBy("source", "rest").agg(F.coalesce(
                F.min_by(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before")), F.when(F.col("upto") >= F.col("rest"), F.col("prefix"))),
                F.max_by(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before")), F.col("prefix"))).alias("b"))
                .select("source", "rest", "b.prefix", "b.before"), f"prefix-{step}")
        else:
            # a document is in if more than half of it lies below the rest
            last = run.groupBy("source").agg(F.max(F.when(F.col("upto") - F.col("n") / 2 < F.col("rest"), F.col("prefix"))).alias("last"),
                                             F.min("prefix").alias("first"))
    # a bare prefix sorts before every key that begins with it: all buckets before are in, none of this one
    cut = last.select(F.col("source").alias("s"), F.coalesce("last", F.substring("first", 1, PREFIX_STEPS[-1])).alias("upto"))
    return write_and_read(t.join(cut, t.source.eqNullSafe(cut.s), "left").select("source", "source_size", "target", "whole", "upto"), "plan")


def _repeats(rows: DataFrame, plan_: DataFrame, key: Column) -> tuple[DataFrame, str, Column]:
    """Rows with the plan of their source in a column of a free name, that name, and how often a row is taken."""
    name = free_name(rows, "plan")
    p = plan_.select(F.struct("source", "source_size", "target", "whole", "upto").alias(name))
    j = rows.join(p, rows["source"].eqNullSafe(p[name]["source"]))
    more = F.when(key <= p[name]["upto"], 1).otherwise(0)
    return j, name, p[name]["whole"] + more


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key"))


def mix_report(docs: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, repeats) of every document."""
    rows = write_and_read(_sized(docs, seed), "sized")
    j, name, repeats = _repeats(rows, plan(rows, **shares), F.col("key"))
    return j.select("doc_id", "size", F.col(name)["source_size"].alias("source_size"), F.col(name)["target"].alias("target"),
                    (F.col("size") * repeats).cast("long").alias("taken"), rows["source"].alias("source"), repeats.alias("repeats"))


def mixed(docs: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession)
    plan_ = plan(scratch.write(_sized(docs, seed), "sized"), **shares)
    scratch.clear()  # the plan is written
    columns = docs.columns
    j, _, repeats = _repeats(docs, plan_, order_key(docs["doc_id"], docs["text"], seed))
    again = F.when(repeats > 0, F.sequence(F.lit(1), repeats)).otherwise(F.array().cast("array<int>"))
    return j.withColumn(free_name(j, "again"), F.explode(again)).select(*[docs[c] for c in columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, 2.0 * sum(size) AS cap,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s),
l AS (SELECT min_by((budget - filled) / free, cap / w) AS level FROM r WHERE (budget - filled) / free * w <= cap),
t AS (SELECT source, source_size, least(cap, w * coalesce(level, 0)) AS target FROM s, l),
u AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (
  SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k) AS upto,
         sum(size) OVER (PARTITION BY d.source, k) AS same
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN rest > 0 AND upto - same / 2 < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source, CAST(whole + CASE WHEN rest > 0 AND upto - same / 2 < rest THEN 1 ELSE 0 END AS INTEGER) AS repeats
FROM g
"""
