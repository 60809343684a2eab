"""Embedding whitening with MLlib's BlockMatrix.

A vector c becomes the integers x = floor(64 c) + 1000000. The fit list is each distinct x once.

* n and the sums S are one aggregate over the fit list, in whole numbers.
* Tasks cut their rows into blocks of `block_rows` rows, centred at S / n: a row is (x - S // n) - (S % n) / n, so no
  digit is lost before the products. A block is a row of a table (block, ids, deviations, values), and becomes a
  MatrixBlock without another exchange. The last block of a task may be shorter; products only pair a block with itself.
* scatter = Bᵀ B over the blocks of the fit list, its middle dimension dealt over tasks, one d x d matrix a task before
  they are added. d x d numbers reach the driver, whatever the number of rows; `eigh` gives components and weights.
* B W over the blocks of all rows, W = components / sqrt(eigenvalues), is the whitened table. Blocks come back with
  their number alone and meet their ids by it, so copies of one vector never meet in one task.
* The identity error is measured on the whitened fit list: (B W)ᵀ (B W) / n.

Cases: rows whose vector is null, or holds null, NaN or infinite entries, or entries beyond +-2^46 (their x has no
place in the arithmetic) are left out, as are vectors of another length than most (ties: the longer); the empty vector
is no vector. Equal vectors count once in the fit and are all returned; repeated and null ids are kept. A component
whose eigenvalue is at most 1e-12 of the trace has no direction of its own: its `whitened` is null, and it is not part of
the identity error. `deviation` is null beyond the range of long. One row, or only copies of it: all components are
such. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_read

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 46
BLOCK_ROWS = 1024
FLAT = 1e-12

_BLOCKS = "part int, seq int, ids array<long>, deviation array<long>, values array<double>"
_PLACE = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType())])
_MATRIX = T.StructType([T.StructField("place", _PLACE), T.StructField("subMatrix", MatrixUDT())])


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that have a vector, of the most frequent length."""
    v = F.col("v")
    fits = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))
    d = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(fits)
    lengths = d.groupBy(F.size("v").alias("d")).count()
    usual = lengths.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    return d.where(F.size("v") == F.lit(usual)).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Rows less their mean as double, and the exact sum of (n x - S)^2 of each row, null beyond long."""
    floor = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    whole = x - floor
    top = (float(np.abs(whole).max(initial=0)) + 1) * n
    if top * top * max(1, x.shape[1]) < 2.0 ** 62:
        exact = whole * n - np.array(rest, dtype=np.int64)
        deviation = (exact * exact).sum(1).tolist()
    else:
        deviation = [sum((v * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in whole.tolist()]
        deviation = [v if v < 1 << 63 else None for v in deviation]
    return whole - np.array([r / n for r in rest]), deviation


def blocks(rows: DataFrame, n: int, sums: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, deviation, values): `rows` (vec_id, x) in blocks, values row by row; blocks are numbered from 0."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(some).combine_chunks()
            x = t.column(1).combine_chunks().flatten().to_numpy().reshape(-1, d)
            values, deviation = centred(x, n, sums)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "ids": pa.array([t.column(0).to_pylist()], pa.list_(pa.int64())),
                "deviation": pa.array([deviation], pa.list_(pa.int64())),
                "values": pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))})

        for b in batches:
            while b.num_rows:
                take = b.slice(0, block_rows - size)
                held.append(take)
                size += take.num_rows
                b = b.slice(take.num_rows)
                if size == block_rows:
                    yield block(held)
                    seq, held, size = seq + 1, [], 0
        if size:
            yield block(held)

    written = write_and_read(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, _BLOCKS), "blocks")
    # one row a task: where its blocks begin
    last = sorted((r.part, r.blocks) for r in written.groupBy("part").agg((F.max("seq") + 1).alias("blocks")).collect())
    begins = dict(zip([p for p, _ in last], np.cumsum([0, *(k for _, k in last)]).tolist(), strict=False))
    begin = written.sparkSession.createDataFrame(list(begins.items()), "part int, begin int")
    return written.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("seq")).alias("block"), "ids", "deviation", "values")


def block_matrix(table: DataFrame, d: int, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The blocks as a distributed matrix, one MatrixBlock a row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a block at a time
                r, values = b.slice(k, 1), b.column(1).slice(k, 1)
                length = len(values.flatten())
                empty = pa.ListArray.from_arrays(pa.array([None, 0], pa.int32()), pa.array([], pa.int32()))
                matrix = pa.StructArray.from_arrays(
                    [pa.array([1], pa.int8()), pa.array([length // d], pa.int32()), pa.array([d], pa.int32()), empty, empty, values, pa.array([True])],
                    ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
                place = pa.StructArray.from_arrays([r.column(0).cast(pa.int64()), pa.array([0], pa.int64())], ["row", "col"])
                yield pa.RecordBatch.from_arrays([place, matrix], names=["place", "subMatrix"])

    java = callMLlibFunc("createBlockMatrix", table.select("block", "values").mapInArrow(run, _MATRIX), block_rows, d, 0, d)
    return BlockMatrix(java, block_rows, d)


def product(a: BlockMatrix, b: BlockMatrix, tasks: int) -> BlockMatrix:
    """a b, with the middle dimension dealt over `tasks`."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def square(a: BlockMatrix, tasks: int) -> np.ndarray:
    """aᵀ a, which has as many rows and columns as `a` has columns."""
    return product(a.transpose(), a, tasks).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns, which of them have a direction), by falling eigenvalue, `most` at most."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = np.maximum(e[::-1][:most], 0), v[:, ::-1][:, :most]
    return e, v, e > FLAT * max(float(np.trace(covariance)), 0.0)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    spark = embeddings.sparkSession
    rows = write_and_read(whole_numbers(embeddings, id_col, vector_col), "whole_numbers")
    fit = write_and_read(rows.groupBy("x").agg(F.lit(0).cast("long").alias("vec_id")).select("vec_id", "x"), "fit")
    some = fit.select("x").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if some is None:
        return spark.createDataFrame([], schema)
    d = len(some.x)
    total = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k]) for k in range(d)]).first()
    n, sums = total[0], list(total[1:])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    fitted = block_matrix(blocks(fit, n, sums, block_rows), d, block_rows)
    covariance = square(fitted, tasks) / n
    e, v, sound = components(covariance, most)
    k = len(e)
    trace = float(np.trace(covariance))
    explained = [float(x / trace) if trace else 0.0 for x in e]
    by = np.where(sound, v / np.sqrt(np.where(sound, e, 1.0)), 0.0)
    java = callMLlibFunc("createBlockMatrix", spark.createDataFrame([((0, 0), DenseMatrix(d, k, by.ravel(order="F").tolist()))], _MATRIX), d, k, d, k)
    weights = BlockMatrix(java, d, k)

    again = square(product(fitted, weights, 1), tasks)[np.ix_(sound, sound)] / n
    error = float(np.abs(again - np.eye(len(again))).max(initial=0.0))

    table = blocks(rows, n, sums, block_rows)
    projected = product(block_matrix(table, d, block_rows), weights, 1)
    back = callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model).select(F.col("_1")["_1"].alias("block"), F.col("_2").alias("matrix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                ids, deviation = b.column(0).slice(at, 1).flatten(), b.column(1).slice(at, 1).flatten()
                m = b.column(2)[at].as_py()
                z = np.array(m["values"]).reshape(m["numRows"], k, order="C" if m["isTransposed"] else "F")
                z = pa.array(z.ravel(), mask=np.tile(~sound, len(ids)))
                each = pa.array(np.repeat(np.arange(len(ids)), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), "n": pa.array(np.full(len(each), n)),
                    "deviation": deviation.take(each), "whitened": z, "explained": pa.array(np.tile(explained, len(ids))),
                    "identity_error": pa.array(np.full(len(each), error))})

    return table.select("block", "ids", "deviation").join(back, "block").select("ids", "deviation", "matrix").mapInArrow(run, schema)
