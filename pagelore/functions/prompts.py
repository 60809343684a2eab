"""Texts put together from ranked sources, and research queries from a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First query form of each research category.
RESEARCH_FORMS = {
    "overview": "what is {}", "history": "history of {}", "current_state": "{} 2024 latest", "technical": "{} how it works",
    "practical": "{} practical examples", "comparison": "{} vs alternatives", "expert_opinion": "{} expert analysis",
    "future_trends": "future of {}", "case_studies": "{} case studies", "best_practices": "{} best practices"}


def fill(form: str, topic: Column) -> Column:
    a, b = form.split("{}")
    return F.concat(F.lit(a), topic, F.lit(b))


def research_queries(topic: Column, n: int = 10, categories: list[str] | None = None) -> Column:
    """The topic, one query per category, then 'detailed analysis' as padding; exactly n."""
    forms = [RESEARCH_FORMS[c] for c in (categories or RESEARCH_FORMS) if c in RESEARCH_FORMS]
    out = [topic] + [fill(f, topic) for f in forms][:max(n - 1, 0)]
    out += [fill("{} detailed analysis", topic)] * (n - len(out))
    return F.array(*out[:n])


def context(ranked: DataFrame, keys: list[str], rank: Column, title: Column, url: Column, body: Column, chars: int | None = None) -> DataFrame:
    """Numbered sources joined by rules, each cut to a length only if one is given. The input holds the few chosen sources per key."""
    block = F.concat(F.lit("[Source "), rank.cast("string"), F.lit("]\nTitle: "), title, F.lit("\nURL: "), url, F.lit("\nContent: "), body if chars is None else F.substring(body, 1, chars))
    d = ranked.select(*keys, F.struct(rank.alias("r"), block.alias("b")).alias("x"))
    return d.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def claim_prompt(claim: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Claim: "), claim, F.lit("\n\nEvidence:\n"), evidence, F.lit("\n\nReply with JSON: verdict, confidence, explanation."))
