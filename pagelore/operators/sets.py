"""Set operations and ordered reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

# Fixed value: order of discovery sources.
SOURCE_RANK = {"sitemap": 1, "index": 2, "search": 3, "crawl": 4}


def source_rank(source: Column) -> Column:
    out = F.lit(5)
    for k, v in SOURCE_RANK.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_filled(df: DataFrame, key: Column, order: list[Column], fill: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the first one, with missing fields taken from the earliest later row that has them.

    Pure aggregates (least order among rows with a value), so copies of a key combine on the map side.
    """
    o = F.struct(*order)
    return df.withColumn("_k", key).groupBy("_k").agg(
        *[F.min_by(c, o).alias(c) for c in keep],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in fill]).withColumnRenamed("_k", "norm_url")


def frontier_order(df: DataFrame) -> list[Column]:
    return [source_rank(F.col("source")), F.col("priority").desc_nulls_last(), F.col("url")]


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 when both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def roll_over(users: DataFrame, existing: DataFrame, key: str, day: Column) -> DataFrame:
    """A zero usage row for every active user without one for the day."""
    want = users.select(key, day.alias("day"))
    return want.join(existing.select(key, "day").distinct(), [key, "day"], "left_anti").withColumn("used", F.lit(0))


def input_urls(given: DataFrame, found: DataFrame, site_map: DataFrame, cap: int | None = None) -> DataFrame:
    """Given addresses, search results and the expansion of 'https://host/*' entries; distinct and well formed."""
    star = given.where(F.col("url").endswith("/*")).select(U.host(F.col("url")).alias("_h")).distinct()
    grown = site_map.withColumn("_h", U.host(F.col("url"))).join(star, "_h", "left_semi").select("url")
    plain = given.where(~F.col("url").endswith("/*")).select("url")
    ok = (U.scheme(F.col("url")) != "") & (U.host(F.col("url")) != "")
    out = plain.unionByName(found.select("url")).unionByName(grown).distinct().where(ok)
    return out.orderBy("url").limit(cap) if cap else out


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Best rows until the running cost first passes the budget.

    A row that costs something and is ranked after `budget` others that do cannot fit; that bounds what the window sees of
    these without changing the result. Rows that cost nothing fit as long as the rows before them do.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_cost", F.greatest(cost, F.lit(0)))
    paid = d.where("_cost > 0").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= budget + 1).drop("_rn")
    run = F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return paid.unionByName(d.where("_cost = 0")).withColumn("_run", run).where(F.col("_run") <= budget).drop("_cost", "_run")
