"""Search provider answers: four JSON layouts to one hit table, and hit parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize, snippet

# List field, url field, text field and score field of each layout (None: no score).
LAYOUTS = {
    "results_score": ("results", "url", "description", "score"),
    "organic": ("organic", "link", "snippet", "position"),
    "organic_results": ("organic_results", "link", "snippet", "position"),
    "results_content": ("results", "url", "content", None),
}


def normalize_payloads(df: DataFrame) -> DataFrame:
    """(id, provider, layout, payload) -> one row per hit: title, url, description, engine, score. The input is read once."""
    def hits(lst: str, url: str, text: str, score: str | None) -> Column:
        fields = f"title string, {url} string, {text} string" + (f", {score} double" if score else "")
        return F.transform(F.from_json("payload", f"{lst} array<struct<{fields}>>")[lst], lambda h: F.struct(
            h["title"].alias("title"), h[url].alias("url"), h[text].alias("description"), (h[score] if score else F.lit(0.0)).alias("score")))

    found = F.lit(None)
    for layout, parts in LAYOUTS.items():
        found = F.when(F.col("layout") == layout, hits(*parts)).otherwise(found)
    return (df.select("id", "provider", F.posexplode(found).alias("pos", "h"))
            .select("id", "pos", "h.title", "h.url", "h.description", F.col("provider").alias("engine"), "h.score"))


def parse_hits(hits: Column, query: Column) -> Column:
    """Hits array -> result structs: first occurrence per URL, rank by raw position, cleaned texts.

    Works inside the row (a response is one row), so nothing is shuffled.
    """
    seen = F.transform(hits, lambda h: h["url"])
    indexed = F.transform(hits, lambda h, i: F.struct(
        (i + 1).alias("rank"),
        F.coalesce(F.nullif(sanitize(h["title"]), F.lit("")), F.lit("Untitled")).alias("title"),
        h["url"].alias("url"),
        F.when(F.length(h["content"]) > 300, snippet(h["content"], query, 250))
        .otherwise(sanitize(h["content"])).alias("snippet"),
        F.get(h["engines"], F.lit(0)).alias("engine")))
    return F.filter(indexed, lambda r: F.array_position(seen, r["url"]) == r["rank"])
