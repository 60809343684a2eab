"""Helpers for JSON whose shape is not known in advance."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(x) -> int:
    if isinstance(x, dict):
        return sum(map(_leaves, x.values()))
    if isinstance(x, list):
        return sum(map(_leaves, x))
    return 1


@F.arrow_udf(T.IntegerType())
def count_leaves(v: pa.Array) -> pa.Array:
    out = []
    for s in v.to_pylist():
        try:
            out.append(None if s is None else _leaves(json.loads(s)))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.int32())


def json_in_text(text: Column, schema: str, array: bool = False) -> Column:
    """First JSON object (or array) inside free text, parsed with the schema; null when there is none."""
    pattern = r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})"
    return F.from_json(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), schema)
