"""Keyed operators that stay balanced when one key owns a large share of the rows.

Nothing here drops, caps or samples rows: a hot group is split into pieces that several tasks
work on, and the pieces are put together from small per-piece summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read

HOT_ROWS = 4096
MOST_HOT_KEYS = 1024


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by `order`. An aggregate, so map tasks combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """Best k rows per key. The rank filter becomes a WindowGroupLimit below the shuffle, so each map
    task sends at most k rows of a key, however hot it is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                spread: int = 16, *, salt_by: Sequence[str]) -> DataFrame:
    """Equi join for a large left side with hot keys and a right side with few rows per key.

    Left rows of a key go to `spread` different partitions; the right rows are copied to each.
    `salt_by` names left columns whose hash picks the copy, so that a rerun task picks the same one; columns of the
    key alone would send all rows of a key to one copy and are refused. The copies are shuffled, never broadcast: Spark
    takes them for as small as the file they come from, and the driver would hold all of them.
    """
    if set(salt_by) <= set(on):
        raise ValueError("the salt needs a column outside of the key")
    l2 = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(spread)).cast("int"))
    r2 = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).hint("merge")
    return l2.join(r2, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys with more than HOT_ROWS rows, the MOST_HOT_KEYS largest of them: any other key owns at most that part of all rows."""
    n = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    return write_and_read(n.orderBy(F.col("_n").desc(), *on).limit(MOST_HOT_KEYS).select(*on), "hot_keys")


def hot_spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: int = 16, *, salt_by: Sequence[str]) -> DataFrame:
    """Inner equi join like `spread_join` for a right side that is large as well: only rows of the left side's hot keys are copied.

    The keys of all other rows keep one copy, so that the shuffle holds both sides once. The left side is read twice.
    """
    if set(salt_by) <= set(on):
        raise ValueError("the salt needs a column outside of the key")
    # MOST_HOT_KEYS rows at most
    hot = F.broadcast(hot_keys(left, on).withColumn("_hot", F.lit(True)))
    l2 = left.join(hot, [*on], "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(spread))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    r2 = right.join(hot, [*on], "left").withColumn("_salt", F.explode(copies)).drop("_hot").hint("merge")
    return l2.join(r2, [*on, "_salt"]).drop("_salt")


def numbered(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[Column],
             name: str = "rn") -> DataFrame:
    """Exact row number per key without sorting a whole key in one task.

    `slice_col` cuts a key into ordered slices (a day, an hour, an id range): every row of a smaller
    slice must sort before every row of a larger one. Rows are numbered inside their slice and moved
    up by the row count of the earlier slices, which is a table of one row per key and slice.
    """
    d = df.withColumn("_slice", slice_col)
    sizes = d.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inside = d.withColumn("_in", F.row_number().over(w))
    return (inside.join(offsets, [*keys, "_slice"])
            .withColumn(name, F.col("_in") + F.col("_off"))
            .drop("_in", "_off", "_slice"))


def running_total(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[Column],
                  measures: dict[str, Column]) -> DataFrame:
    """Sum of each measure from the first row of the key to the current one, split by slices as above."""
    d = df.withColumn("_slice", slice_col)
    for n, c in measures.items():
        d = d.withColumn(f"_m_{n}", c)
    sizes = d.groupBy(*keys, "_slice").agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures])
    w = (Window.partitionBy(*keys, "_slice").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    inside = d
    for n in measures:
        inside = inside.withColumn(f"_i_{n}", F.coalesce(F.sum(f"_m_{n}").over(w), F.lit(0)))
    out = inside.join(offsets, [*keys, "_slice"])
    for n in measures:
        out = out.withColumn(n, F.col(f"_i_{n}") + F.col(f"_o_{n}"))
    return out.drop("_slice", *[f"_{p}_{n}" for p in "mio" for n in measures])


def row_frame(df: DataFrame, keys: Sequence[str], rn: str, before: int, block: int = 4096):
    """Prepare a frame of the `before` preceding rows over numbered rows, in blocks of a fixed length.

    Each block receives copies of the last `before` rows of the block in front of it, so a window over
    (key, block) sees its full frame. Returns the widened rows, the window, and the filter that removes
    the copies afterwards.
    """
    if block <= before:
        raise ValueError("block must be longer than the frame")
    own = ((F.col(rn) - 1) / block).cast("long")
    nxt = ((F.col(rn) - 1 + before) / block).cast("long")
    wide = (df.withColumn("_own", own)
            .withColumn("_block", F.explode(F.array_distinct(F.array(own, nxt)))))
    w = Window.partitionBy(*keys, "_block").orderBy(rn).rowsBetween(-before, 0)
    return wide, w, F.col("_own") == F.col("_block")


def previous_row(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[Column],
                 fields: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Value of `fields` in the row before, per key: lag() that splits a hot key into slices.

    Inside a slice it is lag; the first row of a slice takes the last row of the nearest earlier slice.
    """
    d = df.withColumn("_slice", slice_col)
    st = F.struct(*fields)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ends = d.groupBy(*keys, "_slice").agg(F.max_by(st, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_slice", F.lag("_end").over(
        Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    out = (d.withColumn("_lag", F.lag(st).over(w))
           .join(carried, [*keys, "_slice"]))
    for f in fields:
        out = out.withColumn(prefix + f, F.coalesce(F.col("_lag"), F.col("_carry"))[f])
    return out.drop("_lag", "_carry", "_slice")


def nested(df: DataFrame, keys: Sequence[str], item: Column, id_col: Column, name: str = "items", spread: int = 16) -> DataFrame:
    """Child rows as one sorted array per key, whatever its length.

    The items of a key are collected and sorted in `spread` pieces by several tasks; the second step only joins the
    pieces. A key's array is one value of the result, so it must fit into a row.
    """
    d = df.withColumn("_item", item).withColumn("_piece", F.pmod(F.xxhash64(id_col), F.lit(spread)))
    pieces = d.groupBy(*keys, "_piece").agg(F.collect_list("_item").alias("_items"))
    return pieces.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_items"))).alias(name))
