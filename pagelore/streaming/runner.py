"""Running streaming queries to the end of their input, and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import latest_per_key
from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; state larger than memory spills to local disk and is
    checkpointed to the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet folder or file as a stream. Timestamps without zone become zoned: watermarks need that."""
    r = spark.readStream.schema(like.schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        df = r.parquet(path)
    else:  # a stream reads folders: take the one file out of its folder by name
        folder, name = path.rsplit("/", 1)
        df = r.option("pathGlobFilter", name).parquet(folder)
    ntz = [f.name for f in like.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append sink with exactly-once file output; returns the written rows."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: list[str], order: Column | None = None) -> DataFrame:
    """Update-mode sink: every batch is written under its id, so a repeated batch overwrites itself;
    the result is the newest row per key."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    return latest_per_key(rows, keys, [order if order is not None else F.col("batch")]).drop("batch")


def drain_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None]) -> str:
    """foreachBatch with a folder of its own; `write` must be repeatable for a batch id."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    q = (stream.writeStream.foreachBatch(lambda df, b: write(df, b, out)).option("checkpointLocation", state)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
