"""Typed entities in page texts: finding, validating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Patterns and confidence of the regular expression finder.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "url": r"https?://[^\s<>\"{}|\\^`\[\]]+",
    "price": r"\$\d+(?:\.\d{2})?",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
}


def find_entities(df: DataFrame, text: str, url: str, context: int = 50) -> DataFrame:
    """One row per match: type, index within the type, value, confidence 0.8 and the text around it.

    The position of the n-th match is the length of the first n pieces between matches plus the earlier
    matches, so one pass over the row gives values and offsets without leaving the JVM.
    """
    def matches(kind, pattern):
        size = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + F.length(x))
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
        return let(hits, lambda h: let(F.when(F.size(h) > 0, F.split(F.col(text), pattern)), lambda g: F.transform(h, lambda v, i: F.struct(
            F.lit(kind).alias("entity_type"), i.alias("idx"), v.alias("value"),
            (size(F.slice(g, F.lit(1), i + 1)) + size(F.slice(h, F.lit(1), i))).alias("at")))))

    rows = [matches(kind, "(?i)" + p) for kind, p in PATTERNS.items()]
    d = df.select(url, text, F.explode(F.concat(*rows)).alias("e"))
    lo = F.greatest(F.col("e.at") - context, F.lit(0))
    hi = F.col("e.at") + F.length("e.value") + context
    return d.select(F.concat_ws(":", F.col(url), F.lit("regex"), "e.entity_type", "e.idx").alias("id"), F.col(url).alias("source_url"),
                    "e.entity_type", "e.value", F.lit(0.8).alias("confidence"), F.substring(F.col(text), lo + 1, hi - lo).alias("context"))


def is_valid(kind: Column, value: Column, confidence: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    ok = (F.when(kind == "email", value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
          .when(kind == "phone", digits.between(10, 11)).when(kind == "url", value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"))
          .otherwise(F.lit(True)))
    return ok & (confidence >= 0.5)


def validate(entities: DataFrame, matches: Column, by: str = "entity_type") -> DataFrame:
    """Valid and invalid counts and consistency = valid/total * 0.7 + matches/100 * 0.3."""
    ok = is_valid(F.col("entity_type"), F.col("value"), F.col("confidence"))
    g = entities.groupBy(by).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    return g.withColumn("consistency", F.col("valid") / (F.col("valid") + F.col("invalid")) * 0.7 + matches / 100 * 0.3)
