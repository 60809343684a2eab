"""Keyed state: a fold over the ordered rows of a key, with a small JSON state.

The rows of a key within one trigger are put in order and folded one by one; the state between triggers
holds only what the rule needs (hits of the window, tokens, last hash, last ten durations). Limits per key
are sequential by nature; different keys run in parallel, and the trigger size bounds the rows in memory.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .runner import use_rocksdb


class KeyedFold(StatefulProcessor):
    def __init__(self, step: Callable, order: list[str], names: list[str], ttl_ms: int | None = None):
        self.step, self.order, self.names, self.ttl_ms = step, order, names, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "json string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        st = json.loads(self.state.get()[0]) if self.state.exists() else {}
        pdf = pd.concat(list(rows)).sort_values(self.order)
        out = [r for row in pdf.to_dict("records") for r in self.step(st, row)]
        self.state.update((json.dumps(st),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def fold(stream: DataFrame, key: str, step: Callable, order: list[str], schema: str, ttl_ms: int | None = None) -> DataFrame:
    """Stateful fold of a stream per key; `step(state, row)` changes the state and returns output tuples."""
    use_rocksdb(stream.sparkSession)
    # the processor is also loaded outside the executors, where shipped files are not on the path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=KeyedFold(step, order, names, ttl_ms), outputStructType=schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None")


def sliding_limit(limit: int, seconds: float, key: str, id_col: str):
    """Allow while fewer than `limit` allowed hits lie within the window; denied hits are not stored."""
    def step(st, r):
        hits = [h for h in st.get("hits", []) if h > r["at"] - seconds]
        ok = len(hits) < limit
        if ok:
            hits.append(r["at"])
        st["hits"] = hits
        reset = (hits[0] if hits else r["at"]) + seconds
        return [(r[key], r[id_col], ok, limit - len(hits), reset)]

    return step


def token_bucket(burst: int, per_second: float, key: str, id_col: str):
    """Bucket of `burst` tokens refilled at a rate; the wait is the time to the next token."""
    def step(st, r):
        tokens = min(burst, st.get("tokens", burst) + (r["at"] - st.get("last", r["at"])) * per_second)
        ok = tokens >= 1 - 1e-9
        tokens = tokens - 1 if ok else tokens
        st.update(tokens=tokens, last=r["at"])
        return [(r[key], r[id_col], ok, 0.0 if ok else round((1 - tokens) / per_second, 6))]

    return step


def unseen(keep: int, key: str, item: str):
    """First sight of an item per key among the last `keep` seen."""
    def step(st, r):
        seen = st.setdefault("seen", [])
        if r[item] in seen:
            return []
        seen.append(r[item])
        del seen[:-keep]
        return [(r[key], r[item])]

    return step


def cache_access(ttl: float, key: str, id_col: str):
    """miss stores, hit within the life time, expired stores again."""
    def step(st, r):
        exp = st.get("expires")
        status = "miss" if exp is None else "hit" if r["at"] < exp else "expired"
        if status != "hit":
            st["expires"] = r["at"] + ttl
        return [(r[key], r[id_col], status)]

    return step


def change_of(key: str, id_col: str, digest: str):
    def step(st, r):
        old = st.get("hash")
        st["hash"] = r[digest]
        return [(r[key], r[id_col], "NEW" if old is None else "SAME" if old == r[digest] else "CHANGED")]

    return step


def job_progress(planned: int, key: str, id_col: str):
    """Counts and the estimate from the last ten durations, after each finished item."""
    def step(st, r):
        st["done"] = st.get("done", 0) + 1
        st["last"] = (st.get("last", []) + [r["seconds"]])[-10:]
        eta = (planned - st["done"]) * sum(st["last"]) / len(st["last"])
        return [(r[key], r[id_col], st["done"], round(st["done"] / planned * 100, 6), round(eta, 4))]

    return step
