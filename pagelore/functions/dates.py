"""Periods, expiry and retry times, rate strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def rate_limit(c: Column) -> tuple[Column, Column]:
    """'N/unit' -> (N, seconds); (100, 3600) when it cannot be read."""
    n = F.regexp_extract(c, r"^\s*(\d+)\s*/", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(c, r"/\s*([a-zA-Z]+?)s?\s*$", 1))
    sec = F.lit(None).cast("int")
    for k, v in UNIT_SECONDS.items():
        sec = F.when(unit == k, v).otherwise(sec)
    good = n.isNotNull() & sec.isNotNull()
    return F.when(good, n).otherwise(100), F.when(good, sec).otherwise(3600)


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c)


def period_end(c: Column) -> Column:
    return month_start(c) + F.make_dt_interval(F.lit(30))


def next_midnight(c: Column) -> Column:
    return F.date_trunc("day", c) + F.make_dt_interval(F.lit(1))


def days_remaining(end: Column, now: Column) -> Column:
    return F.datediff(end, now)


def retry_at(at: Column, delay_seconds: int, attempt: Column) -> Column:
    """Exponential back-off: delay * 2^(attempt - 1)."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(delay_seconds) * F.pow(F.lit(2.0), attempt - 1)).cast("decimal(18,6)"))
