"""Ordered analytics per key; hot keys are cut into slices or blocks (see skew)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import numbered, previous_row, row_frame, running_total


def framed(df: DataFrame, keys: list[str], slice_col: Column, order: list[Column], frames: dict[int, dict], name: str = "rn",
           block: int = 4096) -> DataFrame:
    """Aggregates over the current and `before` preceding rows: frames = {before: {column: fn(window)}}.

    Rows are numbered exactly, then each frame runs over fixed blocks with the needed rows copied in.
    """
    out = numbered(df, keys, slice_col, order, name)
    for before, cols in frames.items():
        wide, w, own = row_frame(out, keys, name, before, max(block, before + 1))
        for c, fn in cols.items():
            wide = wide.withColumn(c, fn(w))
        out = wide.where(own).drop("_own", "_block")
    return out


def ewma(df: DataFrame, keys: list[str], slice_col: Column, order: list[Column], value: str, alpha: float = 0.1,
         start_with_first: bool = True) -> DataFrame:
    """Final exponentially weighted mean per key, as one weighted sum.

    With row number r of N the weight is a(1-a)^(N-r); the first value keeps (1-a)^(N-1) when the
    series starts with it, else the series starts at zero. Each slice sums its own rows with the weights they have
    at its end; a slice's sum then fades by the rows of the slices after it. No row meets its whole key.
    """
    fade = F.lit(1 - alpha)
    d = df.withColumn("_slice", slice_col)
    w = Window.partitionBy(*keys, "_slice")
    d = d.withColumn("_in", F.row_number().over(w.orderBy(*order))).withColumn("_cnt", F.count(F.lit(1)).over(w))
    part = d.groupBy(*keys, "_slice").agg(F.sum(F.col(value) * F.lit(alpha) * F.pow(fade, F.col("_cnt") - F.col("_in"))).alias("_sum"),
                                          F.max("_cnt").alias("_cnt"), F.min_by(value, "_in").alias("_first"))
    after = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_after", F.coalesce(F.sum("_cnt").over(after), F.lit(0)))
    out = part.groupBy(*keys).agg(F.sum(F.col("_sum") * F.pow(fade, F.col("_after"))).alias("ewma"), F.sum("_cnt").alias("n"), F.min_by("_first", "_slice").alias("_first"))
    start = F.col("_first") * F.pow(fade, F.col("n")) if start_with_first else F.lit(0.0)
    return out.select(*keys, (F.col("ewma") + start).alias("ewma"), "n")


def cumulative_mean(df: DataFrame, keys: list[str], slice_col: Column, order: list[Column], value: str) -> DataFrame:
    d = running_total(df, keys, slice_col, order, {"_sum": F.col(value), "_cnt": F.lit(1)})
    return d.withColumn("cumulative_mean", F.col("_sum") / F.col("_cnt")).drop("_sum", "_cnt")


def failure_runs(df: DataFrame, keys: list[str], slice_col: Column, order: list[Column], ok: Column) -> DataFrame:
    """Consecutive failures at each row: rows since the last success, by gaps and islands.

    The island id is the running number of successes; an island's first row number is an aggregate.
    """
    d = running_total(df.withColumn("_ok", ok), keys, slice_col, order, {"_isl": F.col("_ok").cast("int"), "_rn": F.lit(1)})
    head = d.groupBy(*keys, "_isl").agg(F.min("_rn").alias("_first"))
    j = d.join(head, [*keys, "_isl"])
    return (j.withColumn("consecutive_failures", F.when(F.col("_ok"), 0).otherwise(
        F.col("_rn") - F.col("_first") + F.when(F.col("_isl") == 0, 1).otherwise(0)))
        .withColumnRenamed("_rn", "rn").drop("_isl", "_first", "_ok"))


def health(runs: Column, failure_rate: Column, seconds: Column, ok: Column, error: Column) -> Column:
    """State after an attempt. 5 failures in a row, 70 percent, 2 and 5 seconds, 10 disables."""
    blocked = F.lower(error).rlike("blocked|forbidden")
    after_ok = F.when(seconds < 2, "healthy").when(seconds < 5, "slow").otherwise("unhealthy")
    return (F.when(ok, after_ok).when(runs >= 10, "disabled").when((runs >= 5) & blocked, "blocked").when(runs >= 5, "unhealthy")
            .when(failure_rate > 70, "unhealthy").otherwise("unknown"))


STATE_FACTOR = {"healthy": 1.0, "slow": 0.7, "unknown": 0.8, "unhealthy": 0.2, "blocked": 0.1, "disabled": 0.0}


def priority(success_rate: Column, avg_seconds: Column, runs: Column, state: Column) -> Column:
    f = F.lit(0.5)
    for k, v in STATE_FACTOR.items():
        f = F.when(state == k, v).otherwise(f)
    time_factor = F.when(avg_seconds > 0, F.greatest(F.lit(0.1), 1 - avg_seconds / 10)).otherwise(1.0)
    return success_rate / 100 * time_factor * F.greatest(F.lit(0.1), 1 - runs * 0.2) * f


def change_status(df: DataFrame, keys: list[str], slice_col: Column, order: list[Column], digest: str) -> DataFrame:
    d = previous_row(df, keys, slice_col, order, [digest])
    p = F.col(f"prev_{digest}")
    return d.withColumn("status", F.when(p.isNull(), "NEW").when(p == F.col(digest), "SAME").otherwise("CHANGED"))


def moving_rate(df: DataFrame, key: str, second: str, spans: dict[str, int], block: int = 86400) -> DataFrame:
    """Requests in the last n seconds at each busy second. Counting per second comes first; long series
    are cut into blocks of seconds whose head gets a copy of the preceding seconds."""
    per = df.groupBy(key, second).agg(F.count(F.lit(1)).alias("n"))
    reach = max(spans.values())
    own, nxt = F.floor(F.col(second) / block), F.floor((F.col(second) + reach) / block)
    wide = per.withColumn("_own", own).withColumn("_b", F.explode(F.array_distinct(F.array(own, nxt))))
    for name, n in spans.items():
        w = Window.partitionBy(key, "_b").orderBy(second).rangeBetween(-(n - 1), 0)
        wide = wide.withColumn(name, F.sum("n").over(w))
    return wide.where("_own = _b").drop("_own", "_b")
