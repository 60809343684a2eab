"""Registered queries: name -> (function of session and input folder, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


SPLIT_BYTES = 64 << 20
PIECE_BYTES = 16 << 20


class Inputs:
    """Lazy access to the input tables: t.pages, t.documents, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str) -> DataFrame:
        """The table for work that is heavy per row (parsing, tokens, chunks).

        A table of few bytes comes as one or two splits and would keep one core busy, so it is dealt out
        over all cores. A table with at least a full split per core is read as it is, without a shuffle.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(cores * 2, df.columns[0]) if size < cores * SPLIT_BYTES else df

    def by_id(self, name: str, df: DataFrame | None = None, piece: int = PIECE_BYTES) -> DataFrame:
        """The table (or `df`, made of it row by row) dealt out by its first column, in pieces of bounded size.

        For work that makes many small rows of a text and groups them by its id: the text is shuffled once, the rows are not.
        """
        table = getattr(self, name)
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        pieces = max(self.spark.sparkContext.defaultParallelism * 2, size // piece + 1)
        return (table if df is None else df).repartition(pieces, table.columns[0])

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register a query working on an Inputs object."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Inputs(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
