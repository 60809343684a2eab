"""Data retention: policies, expiry, sweep, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours a policy keeps data; permanent is a hundred years.
POLICY_HOURS = {"0h": 0, "1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "permanent": 876000}


def policy_of(data_type: Column, tags: Column, rules: list[dict], default: str = "24h") -> Column:
    """First rule of the same type whose tags overlap (or that names none) and whose exceptions do not."""
    out = None
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    for r in rules:
        hit = data_type == r["data_type"]
        if r.get("tags"):
            hit = hit & F.arrays_overlap(tags, arr(r["tags"]))
        if r.get("except"):
            hit = hit & ~F.arrays_overlap(tags, arr(r["except"]))
        out = F.when(hit, r["policy"]) if out is None else out.when(hit, r["policy"])
    return F.lit(default) if out is None else out.otherwise(default)


def expires_at(created: Column, policy: Column) -> Column:
    hours = F.lit(24)
    for p, h in POLICY_HOURS.items():
        hours = F.when(policy == p, h).otherwise(hours)
    return created + F.make_dt_interval(F.lit(0), hours)


def sweep(records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) split by expiry."""
    return records.where(F.col("expires_at") > now), records.where(F.col("expires_at") <= now)


def extend(records: DataFrame, ids: DataFrame, key: str, hours: int) -> DataFrame:
    """Moves the expiry of the listed records; the others stay."""
    mark = ids.select(key).distinct().withColumn("_x", F.lit(True))
    return (records.join(mark, key, "left")
            .withColumn("expires_at", F.when(F.col("_x"), F.col("expires_at") + F.make_dt_interval(F.lit(0), F.lit(hours)))
                        .otherwise(F.col("expires_at"))).drop("_x"))


def compliance(records: DataFrame, queue: DataFrame, key: str, now: Column) -> DataFrame:
    """Totals, expired, bytes and violations: a record that has expired and is not queued for deletion."""
    marked = records.join(queue.select(key).distinct().withColumn("_q", F.lit(True)), key, "left")
    expired = F.col("expires_at") <= now
    bad = expired & F.col("_q").isNull()
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(expired).alias("expired"),
                      F.sum("size_bytes").alias("bytes"), F.count_if(bad).alias("violations")).withColumn(
        "score", F.greatest(F.lit(0.0), 1 - F.col("violations") / F.col("total")))
