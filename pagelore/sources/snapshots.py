"""Content-addressed snapshots and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import snapshot_key
from ..operators.skew import nested


def snapshot_rows(df: DataFrame, content: Column) -> DataFrame:
    """Adds content_sha256, byte length and snapshot key."""
    sha = F.sha2(content.cast("binary"), 256)
    return (df.withColumn("content_sha256", sha).withColumn("n_bytes", F.octet_length(content))
            .withColumn("snapshot_key", snapshot_key(F.col("content_sha256"))))


def new_snapshots(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Put if absent: one row per hash not yet stored."""
    return incoming.dropDuplicates(["content_sha256"]).join(
        stored.select("content_sha256"), ["content_sha256"], "left_anti")


def write_snapshots(df: DataFrame, path: str) -> None:
    """Appended under aa/bb folders of the hash; rows of one folder are brought together first, in as many tasks as there
    are folders."""
    (df.withColumn("aa", F.substring("content_sha256", 1, 2)).withColumn("bb", F.substring("content_sha256", 3, 2))
     .repartition("aa", "bb").write.mode("append").partitionBy("aa", "bb").parquet(path))


def write_audit(df: DataFrame, path: str) -> None:
    """JSON audit rows partitioned by day; the range sort keeps one key's rows of a day in few files."""
    (df.withColumn("dt", F.date_format("created_at", "yyyy-MM-dd"))
     .repartitionByRange("dt", "api_key_id", "created_at").sortWithinPartitions("dt", "api_key_id", "created_at")
     .write.mode("append").partitionBy("dt").json(path))


def read_audit(spark, path: str, schema: str, api_key_id, start: str, end: str, limit: int, offset: int = 0):
    d = spark.read.schema(schema).json(path)
    return (d.where((F.col("dt") >= start) & (F.col("dt") <= end) & (F.col("api_key_id") == api_key_id))
            .orderBy(F.col("created_at").desc(), F.col("event_id").desc()).offset(offset).limit(limit))


def audit_rows(refs: DataFrame, request: str, api_key: str) -> DataFrame:
    """One row per request with its envelope references; requests without a key are skipped."""
    item = F.struct("url", "snapshot_key", "content_sha256", "signed_at")
    return nested(refs.where(F.col(api_key).isNotNull()), [request, api_key], item, F.col("url"), "refs")
