"""Attribute values of elements: conversions, transforms, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import urls as U

TRUE_WORDS = ("true", "1", "yes", "on", "checked", "selected")


def numeric(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def boolean(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*TRUE_WORDS), F.lit(False))


def as_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,;|\n]"), lambda s: F.trim(s)), lambda x: x != "")


def converted(c: Column, kind: str, base: Column | None = None) -> Column:
    """Value as text for the kinds raw, cleaned, urls_resolved, numeric, boolean and list."""
    if kind == "cleaned":
        return X.clean(c)
    if kind == "urls_resolved":
        return U.resolve(base, c) if base is not None else c
    if kind == "numeric":
        return numeric(c).cast("string")
    if kind == "boolean":
        return boolean(c).cast("string")
    if kind == "list":
        return F.array_join(as_list(c), ",")
    return c


def transform(c: Column, rule: str) -> Column:
    if rule.startswith("regex:"):
        pattern = rule[6:]
        group = 1 if "(" in pattern.replace("(?:", "").replace("\\(", "") else 0
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    named = {"uppercase": F.upper(c), "lowercase": F.lower(c),
             "capitalize": F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_000_000_000)))}
    for call, out in (("toLowerCase()", F.lower(c)), ("toUpperCase()", F.upper(c)), ("trim()", F.trim(c))):
        if rule.startswith("js:") and call in rule:
            return out
    return named.get(rule, c)


def valid(c: Column, pattern: str | None) -> Column:
    return F.lit(True) if not pattern else F.coalesce(c, F.lit("")).rlike(pattern)
