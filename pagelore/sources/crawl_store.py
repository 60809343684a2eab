"""Crawl records: keyed upsert, search, export, cutoff deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import short_sha
from ..operators.skew import latest_per_key


def record_key(url: Column, content: Column) -> Column:
    return short_sha(F.concat_ws(":", url, content), 16)


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: the incoming row wins. One shuffle, combined on the map side."""
    both = base.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)),
                                                         allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col("_gen")]).drop("_gen")


def append_absent(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `incoming` whose key the base does not hold (INSERT OR IGNORE), one per key."""
    return incoming.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")


def search(df: DataFrame, needle: str, fields: list[str], order: list[Column], limit: int = 100,
           offset: int = 0) -> DataFrame:
    """Literal substring search over several text columns, paged."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.col(f), F.lit(needle))
    return df.where(hit).orderBy(*order).offset(offset).limit(limit)


def export(df: DataFrame, path: str, fmt: str, order: list[Column]) -> None:
    """Range-partitioned sort, so that the files in name order are in the wanted order."""
    w = df.orderBy(*order).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def drop_older(df: DataFrame, ts: Column, now: Column, days: int = 30) -> DataFrame:
    return df.where(ts >= now - F.make_dt_interval(F.lit(days)))
