"""Session set-up and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_TABLES: dict[tuple[str, str, str], str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    b = (
        SparkSession.builder.master(master)
        .appName("pagelore")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGELORE_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's spark.checkpoint.dir.

    Only where that setting is absent on a single machine (tests) a temporary folder stands in; on a cluster its lack
    is an error, since executors would write where the others cannot read.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/pagelore/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of one's own that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_and_read(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage through a written Parquet table, so that a lost executor costs one stage only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Intermediate tables that are deleted together once their reader has written its own result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, *self.paths)
        self.paths.clear()


def table_once(spark: SparkSession, scope: str, name: str, make) -> DataFrame:
    """Build a shared intermediate (parsed pages, postings) once per application and input folder."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _TABLES:
        path = scratch_path(spark, name)
        make().write.mode("overwrite").parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def bucketed_once(spark: SparkSession, scope: str, name: str, make, by: str) -> DataFrame:
    """Like `table_once`, but stored in buckets by a column: what is grouped by it (and more) later needs no exchange.

    `make(deal)` builds it from a table that `deal` has dealt out over the buckets, row-local or grouped by that column (and more)
    alone: the small rows made of a text are then not shuffled again.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _TABLES:
        table = f"pagelore_{name}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # one writing task per bucket, so that a bucket is one file
        (make(lambda df: df.repartition(buckets, by)).write.bucketBy(buckets, by).option("path", scratch_path(spark, name)).format("parquet").saveAsTable(table))
        _TABLES[key] = table
    return spark.table(_TABLES[key])


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    app = spark.sparkContext.applicationId
    if _FALLBACK.get(f"shipped:{app}"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "pagelore.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "pagelore")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)
    _FALLBACK[f"shipped:{app}"] = target
