"""Encoder hook: text to vector. The default is a signed hashing encoder; a model can take its place."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W]+")


@lru_cache(maxsize=200_000)
def _slot(token: str, dims: int) -> tuple[int, float]:
    h = hashlib.md5(token.encode()).digest()
    return int.from_bytes(h[:4], "big") % dims, 1.0 if h[4] & 1 else -1.0


def hash_batch(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of signed token counts; empty text gives the zero vector."""
    out = np.zeros((len(texts), dims))
    for i, s in enumerate(texts):
        for tok in _TOKEN.findall((s or "").lower()):
            j, sign = _slot(tok, dims)
            out[i, j] += sign
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def encoder(fn: Callable[[list[str]], np.ndarray], batch: int = 20):
    """Column function from a batch encoder; a batch that fails gives zero vectors, as the service does."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        rows, dims = [], 1
        for i in range(0, len(texts), batch):
            part = texts[i:i + batch]
            try:
                m = np.asarray(fn(part), dtype=np.float32)
                dims = m.shape[1]
                rows.extend(m)
            except Exception:
                rows.extend([None] * len(part))
        rows = [np.zeros(dims, np.float32) if r is None else r for r in rows]
        return pa.array(rows, pa.list_(pa.float32()))

    return encode


hashing_encoder: Callable[[Column], Column] = encoder(hash_batch)
