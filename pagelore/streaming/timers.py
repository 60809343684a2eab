"""Deliveries with timers: what has to happen when nothing arrives.

Both machines keep a few numbers per delivery or message and a timer in event time, so a retry or an end comes when the
watermark passes it. They go through the rows of a key as these come: the rows that can still matter are as few as the
attempts that are left, whatever the number of rows of the key.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .runner import use_rocksdb

PENDING, FAILED, SENT, ABANDONED = "PENDING", "FAILED", "SENT", "ABANDONED"
DELIVERY = "delivery_id long, state string, attempts int, at double, turn int"
ROUTED = "id long, type string, outcome string, attempt int, at double, waited double, turn int"


def _register(*functions: Callable) -> None:
    """The processors and what they call are also loaded where shipped files are not on the path."""
    for name in (__name__, *(f.__module__ for f in functions)):
        if name != "__main__":
            cloudpickle.register_pickle_by_value(sys.modules[name])


class Delivery(StatefulProcessor):
    """PENDING until the first attempt; SENT by a success; FAILED by a failure, which waits `delay * backoff^(n-1) + grace` seconds
    for its retry; ABANDONED after `most` failures or when no retry came in that time. The last two states stay."""

    def __init__(self, most: int, delay: float, backoff: float, grace: float):
        self.most, self.delay, self.backoff, self.grace = most, delay, backoff, grace

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "state string, attempts int, deadline double, turn int")

    def _read(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, 0, None, 0]

    def _wait(self, attempts: int) -> float:
        return self.delay * self.backoff ** (attempts - 1) + self.grace

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, attempts, deadline, turn = self._read()
        if state in (SENT, ABANDONED):
            for _ in rows:
                pass
            return
        left, created, known = [], None, state
        for pdf in rows:
            made = pdf.loc[pdf["ok"].isna(), "at"]
            if len(made):
                created = made.min() if created is None else min(created, made.min())
            tries = pdf.loc[pdf["ok"].notna(), ["at", "id", "ok"]]
            left = heapq.nsmallest(self.most - attempts, [*left, *tries.itertuples(index=False, name=None)])
        out, old = [], deadline

        def say(at: float) -> None:
            nonlocal turn
            turn += 1
            out.append((key[0], state, attempts, float(at), turn))

        if state is None and created is not None:
            state = PENDING
            say(created)
        for at, _, ok in left:
            if state == FAILED and at > deadline:
                state = ABANDONED
                say(deadline)
            if state == ABANDONED:
                break
            attempts += 1
            state = SENT if ok else ABANDONED if attempts >= self.most else FAILED
            deadline = at + self._wait(attempts) if state == FAILED else deadline
            say(at)
            if state == SENT:
                break
        if old is not None and (state != FAILED or deadline != old):
            self.handle.deleteTimer(int(old * 1000))
        if state == FAILED and deadline != old:
            self.handle.registerTimer(int(deadline * 1000))
        if state is not None and (out or state != known):
            self.state.update((state, attempts, deadline if state == FAILED else None, turn))
        yield pd.DataFrame(out, columns=["delivery_id", "state", "attempts", "at", "turn"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, attempts, deadline, turn = self._read()
        if state == FAILED and int(deadline * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((ABANDONED, attempts, None, turn + 1))
            yield pd.DataFrame([(key[0], ABANDONED, attempts, deadline, turn + 1)], columns=["delivery_id", "state", "attempts", "at", "turn"])

    def close(self) -> None:
        pass


def deliveries(attempts: DataFrame, watermark: str, most: int = 3, delay: float = 60.0, backoff: float = 2.0, grace: float = 0.0) -> DataFrame:
    """Changes of state as a stream: (delivery_id, state, attempts, at, turn); the greatest `turn` of a delivery is its state.

    `attempts` is (delivery_id, id, ts, ok): ok null announces a delivery, otherwise a row is an attempt. Attempts count in the order
    of time and id within a trigger; rows without time or delivery are left out.
    """
    use_rocksdb(attempts.sparkSession)
    _register()
    d = attempts.where("ts is not null and delivery_id is not null").withWatermark("ts", watermark)
    d = d.selectExpr("delivery_id", "id", "ts", "CAST(ts AS double) AS at", "ok")
    return d.groupBy("delivery_id").transformWithStateInPandas(Delivery(most, delay, backoff, grace), outputStructType=DELIVERY, outputMode="Update", timeMode="EventTime")


class Retry(StatefulProcessor):
    """Each message is handled once per attempt: a failure is tried again after min(longest, first * 2^attempt) seconds, and is
    a dead letter if it fails at attempt `most` or later. A message that comes again changes nothing."""

    def __init__(self, handler: Callable[[str, str, int], bool], most: int, first: float, longest: float):
        self.handler, self.most, self.first, self.longest = handler, most, first, longest

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", "type string, body string, attempt int, at double, waited double, outcome string, turn int")

    def _go(self, key, kind: str, body: str, attempt: int, at: float, waited: float, turn: int, watermark: float) -> pd.DataFrame:
        """Attempts until one succeeds, none is left, or the next is due after the watermark."""
        out = []
        while True:
            turn += 1
            ok = self.handler(kind, body, attempt)
            outcome = "done" if ok else "dead" if attempt >= self.most else "waiting"
            out.append((key[0], kind, outcome, attempt, at, waited, turn))
            if outcome != "waiting":
                break
            pause = min(self.longest, self.first * 2 ** attempt)
            due = at + pause
            if due > watermark:
                self.handle.registerTimer(int(due * 1000))
                break
            attempt, at, waited = attempt + 1, due, waited + pause
        self.state.update((kind, body, attempt, at, waited, outcome, turn))
        return pd.DataFrame(out, columns=["id", "type", "outcome", "attempt", "at", "waited", "turn"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:  # the same message, again and again
            row = min(pdf[["at", "attempt", "type", "body"]].itertuples(index=False, name=None))
            first = row if first is None or row < first else first
        if first is not None and not self.state.exists():
            at, attempt, kind, body = first
            yield self._go(key, kind, body, int(attempt), float(at), 0.0, 0, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, body, attempt, at, waited, outcome, turn = self.state.get()
        if outcome == "waiting":
            pause = min(self.longest, self.first * 2 ** attempt)
            yield self._go(key, kind, body, attempt + 1, at + pause, waited + pause, turn, timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def retried(messages: DataFrame, handler: Callable[[str, str, int], bool], watermark: str, most: int = 5, first: float = 30.0, longest: float = 3600.0) -> DataFrame:
    """Every attempt at every message as a stream: (id, type, outcome done, waiting or dead, attempt, at, waited, turn).

    `messages` is (id, type, body, attempt, ts); `handler(type, body, attempt)` does the work and says whether it succeeded. A message
    that arrives with attempt `most` or more has one try left. Rows without id or time are left out; a null attempt is 1,
    null types and bodies are empty.
    """
    use_rocksdb(messages.sparkSession)
    _register(handler)
    m = messages.where("id is not null and ts is not null").withWatermark("ts", watermark)
    m = m.selectExpr("id", "ts", "CAST(ts AS double) AS at", "coalesce(attempt, 1) AS attempt", "coalesce(type, '') AS type", "coalesce(body, '') AS body")
    return m.groupBy("id").transformWithStateInPandas(Retry(handler, most, first, longest), outputStructType=ROUTED, outputMode="Update", timeMode="EventTime")
