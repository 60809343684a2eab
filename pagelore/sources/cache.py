"""Cached content with expiry and the five cache modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import short_sha

READS = ("enabled", "read_only")
WRITES = ("enabled", "write_only")


def cache_key(url: Column) -> Column:
    return short_sha(url, 16)


def lookup(requests: DataFrame, cache: DataFrame, key: str, now: Column, mode: str = "enabled") -> DataFrame:
    """Adds `cache_status`: hit, expired or miss; bypass when the mode does not read.

    A plain equi join, so adaptive execution splits the partition of a hot address; the cache holds one row per key.
    """
    if mode not in READS:
        return requests.withColumn("cache_status", F.lit("bypass"))
    j = requests.join(cache.select(key, F.col("expires_at").alias("_e")), key, "left")
    status = F.when(F.col("_e").isNull(), "miss").when(F.col("_e") > now, "hit").otherwise("expired")
    return j.withColumn("cache_status", status).drop("_e")


def rows_to_store(looked_up: DataFrame, key: str, mode: str = "enabled") -> DataFrame:
    """Keys to fetch and append after a lookup."""
    d = looked_up.where(F.col("cache_status") != "hit").select(key).distinct()
    return d if mode in WRITES else d.limit(0)


def invalidate(cache: DataFrame, key: str, pattern: str) -> DataFrame:
    return cache.where(~F.col(key).rlike(pattern))
