"""Text comparison of two versions, in Arrow batches (small helpers around difflib)."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("content", T.StringType())])
_ARROW_LINE = pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32()), ("content", pa.string())]))


def _pairs(a: pa.Array, b: pa.Array, fn, typ):
    return pa.array([None if x is None or y is None else fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], typ)


def changed_percent(old: str, new: str) -> float:
    return (1 - difflib.SequenceMatcher(None, old, new).ratio()) * 100


def line_changes(old: str, new: str) -> list[dict]:
    a, b = old.splitlines(), new.splitlines()
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            out += [{"kind": "delete", "line": i + 1, "content": a[i]} for i in range(i1, i2)]
            out += [{"kind": "add", "line": j + 1, "content": b[j]} for j in range(j1, j2)]
    return out


def unified(old: str, new: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), fromfile="previous", tofile="current", lineterm=""))


@F.arrow_udf(T.DoubleType())
def change_percentage(a: pa.Array, b: pa.Array) -> pa.Array:
    """100 * (1 - similarity ratio) of two whole texts; null when either is missing."""
    return _pairs(a, b, changed_percent, pa.float64())


@F.arrow_udf(T.ArrayType(LINE))
def diff_lines(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(a, b, line_changes, _ARROW_LINE)


@F.arrow_udf(T.StringType())
def unified_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(a, b, unified, pa.string())
