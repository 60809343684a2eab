"""Adaptive crawls: many at once, each with a state of its own that says when it has learned enough.

A round is two written tables below the crawl's folder: `frontier` (crawl, node, score, found, visited), all addresses a
running crawl knows, and `state`, one row per crawl with its term set, the recent counts of new terms, quality and
relevance, confidence, the reason why it ended, and the log of the round. The state of a round is written last, so a
run that was interrupted goes on after the last round that has one, with the same rows as an undisturbed run.

A round takes the best `batch` open addresses of every crawl (score, then the round it was found in, then address),
joins them to the pages and folds them into the state one after the other: within a batch as well, a crawl ends at the
very page that a sequential crawl ends at. With batch 1 the order is the sequential one too; larger batches rank the
links of a batch's pages only after the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import path_exists, scratch_path
from .skew import spread_join, top_per_key

HISTORY = 20  # kept values of each measure
STATE = ("crawl string, query array<string>, terms array<string>, fresh array<int>, quality array<double>, relevance array<double>, pages int, tries int, "
         "confidence double, reason string, log array<struct<pos:int,node:string,score:double,fetched:boolean,new_terms:int,quality:double,relevance:double,confidence:double,reason:string>>")
LOG = "array<struct<pos:int,node:string,score:double,fetched:boolean,new_terms:int,quality:double,relevance:double,confidence:double,reason:string>>"


@dataclass(frozen=True)
class StopRules:
    """When a crawl ends, looked at after every page in this order; None leaves a rule out."""

    max_pages: int | None = 20
    saturation_pages: int = 5  # mean of so many new-term counts ...
    saturation_terms: float | None = 5.0  # ... below this
    confidence: float | None = 0.7
    quality: float | None = 0.3  # mean of the last three
    max_tries: int | None = None  # pages asked for, missing ones included
    expected_terms: float = 50.0


def _last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def _spread(a: Column) -> Column:
    """Population standard deviation."""
    return _let(_mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _confidence(s: Column, rules: StopRules) -> Column:
    """0.4 of the share of known terms, 0.3 each of steady quality and relevance; a part needs two values."""
    z = F.lit(0.0)
    gain = F.when(F.size(s["fresh"]) > 1, 1 - _mean(_last(s["fresh"], 3)) / rules.expected_terms).otherwise(z)
    steady = [F.when(F.size(s[m]) > 1, F.greatest(z, 1 - _spread(_last(s[m], 5)))).otherwise(z) for m in ("quality", "relevance")]
    return F.round(0.4 * gain + 0.3 * steady[0] + 0.3 * steady[1], 12)


def _reason(s: Column, rules: StopRules) -> Column:
    """The first rule that ends the crawl, null if it goes on."""
    found = F.when(F.lit(False), "")
    if rules.max_pages is not None:
        found = found.when(s["pages"] >= rules.max_pages, "pages")
    if rules.saturation_terms is not None:
        n = rules.saturation_pages
        found = found.when((F.size(s["fresh"]) >= n) & (_mean(_last(s["fresh"], n)) < rules.saturation_terms), "saturation")
    if rules.confidence is not None:
        found = found.when(s["confidence"] >= rules.confidence, "confidence")
    if rules.quality is not None:
        found = found.when((F.size(s["quality"]) >= 3) & (F.round(_mean(_last(s["quality"], 3)), 12) < rules.quality), "quality")
    if rules.max_tries is not None:
        found = found.when(s["tries"] >= rules.max_tries, "tries")
    return found


def _visit(s: Column, p: Column, rules: StopRules) -> Column:
    """The state after one page; a page that is missing or without terms changes the number of tries alone."""
    readable = F.coalesce(F.size(p["terms"]) > 0, F.lit(False))
    fresh = F.array_except(p["terms"], s["terms"])
    both = F.size(F.array_intersect(p["terms"], s["query"]))
    relevance = F.when(F.size(s["query"]) > 0, both / F.size(F.array_union(p["terms"], s["query"]))).otherwise(0.0)

    def learned(u: Column) -> Column:
        """Names the counts of the page, so that each is computed once."""
        more = lambda name, value: _last(F.concat(s[name], F.array(value)), HISTORY)
        return F.struct(s["query"].alias("query"), F.concat(s["terms"], u["new"]).alias("terms"), more("fresh", F.size(u["new"])).alias("fresh"), more("quality", F.coalesce(p["quality"], F.lit(0.0))).alias("quality"),
                        F.when(F.size(s["query"]) > 0, more("relevance", u["relevance"])).otherwise(s["relevance"]).alias("relevance"), (s["pages"] + 1).alias("pages"), (s["tries"] + 1).alias("tries"))

    known = _let(F.struct(fresh.alias("new"), relevance.alias("relevance")), learned)
    same = F.struct(s["query"].alias("query"), s["terms"].alias("terms"), s["fresh"].alias("fresh"), s["quality"].alias("quality"), s["relevance"].alias("relevance"), s["pages"].alias("pages"),
                    (s["tries"] + 1).alias("tries"))

    def closed(u: Column) -> Column:
        confidence = F.when(readable, _confidence(u, rules)).otherwise(s["confidence"])
        return _let(F.struct(u["pages"].alias("pages"), u["tries"].alias("tries"), u["fresh"].alias("fresh"), u["quality"].alias("quality"), confidence.alias("confidence")), lambda v: _let(
            _reason(v, rules), lambda why: F.struct(
                *[u[c].alias(c) for c in ("query", "terms", "fresh", "quality", "relevance", "pages", "tries")], v["confidence"].alias("confidence"), why.alias("reason"),
                F.concat(s["log"], F.array(F.struct(
                    p["pos"].alias("pos"), p["node"].alias("node"), p["score"].alias("score"), readable.alias("fetched"), F.when(readable, F.element_at(u["fresh"], -1)).otherwise(0).alias("new_terms"),
                    F.when(readable, F.coalesce(p["quality"], F.lit(0.0))).alias("quality"), F.when(readable & (F.size(s["query"]) > 0), F.element_at(u["relevance"], -1)).alias("relevance"), v["confidence"].alias("confidence"), why.alias("reason")))).alias("log"))))

    return F.when(s["reason"].isNotNull(), s).otherwise(_let(F.when(readable, known).otherwise(same), closed))


_FIELDS = ("query", "terms", "fresh", "quality", "relevance", "pages", "tries", "confidence", "reason", "log")


def adaptive_crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, rules: StopRules | None = None, batch: int = 1, min_score: float = 0.3,
                   folder: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """(crawl, round, pos, node, score, fetched, new_terms, quality, relevance, confidence, reason), a row per page asked for.

    `pages` are (node, terms array<string>, quality), one row per node, `links` (src, dst, score), `seeds` (crawl, node, query
    array<string>), one per crawl. Only links of `min_score` or more are followed; `reason` stands in the last row of a crawl
    that a rule has ended, and is null where it ran out of addresses. `folder` keeps the rounds; a call with a folder that has
    some goes on from there. `max_rounds` ends the call, not the crawls.

    Cases: crawls, addresses and terms may be null only by leaving no row: rows with a null crawl or node are left out;
    repeated pages, links and seeds count once (the least query of a crawl and node); a page without terms counts as missing;
    a null quality is 0; no seeds give no rows.
    """
    spark = pages.sparkSession
    rules = rules or StopRules()
    folder = folder or scratch_path(spark, "adaptive")
    at = lambda name, r: f"{folder}/{name}/round={r}"
    pages = pages.where("node is not null").groupBy("node").agg(F.min(F.struct(F.array_sort(F.array_distinct(F.coalesce("terms", F.array().cast("array<string>")))).alias("terms"), F.col("quality").cast("double").alias("quality"))).alias("p"))
    pages = pages.select("node", "p.terms", "p.quality")
    edges_at = f"{folder}/links"
    if not path_exists(spark, f"{edges_at}/_SUCCESS"):
        links.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.max("score").cast("double").alias("score")).where(F.col("score") >= min_score).write.mode("overwrite").parquet(edges_at)
    edges = spark.read.parquet(edges_at)

    r = 0
    while path_exists(spark, f"{at('state', r)}/_SUCCESS"):
        r += 1
    if r == 0:
        first = seeds.where("crawl is not null and node is not null").groupBy(F.col("crawl").cast("string").alias("crawl")).agg(F.min(F.struct("node", "query")).alias("s")).select("crawl", "s.*")
        none = lambda kind: F.array().cast(f"array<{kind}>")
        first.select("crawl", "node", F.lit(1.0).alias("score"), F.lit(0).alias("found"), F.lit(None).cast("int").alias("visited")).write.mode("overwrite").parquet(at("frontier", 0))
        first.select("crawl", F.coalesce("query", none("string")).alias("query"), none("string").alias("terms"), none("int").alias("fresh"), none("double").alias("quality"), none("double").alias("relevance"),
                     F.lit(0).alias("pages"), F.lit(0).alias("tries"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.array().cast(LOG).alias("log")).write.mode("overwrite").parquet(at("state", 0))
        r = 1

    last = None if max_rounds is None else r + max_rounds
    while last is None or r < last:
        frontier, state = spark.read.parquet(at("frontier", r - 1)), spark.read.schema(STATE).parquet(at("state", r - 1))
        order = [F.col("score").desc(), F.col("found"), F.col("node")]
        chosen = top_per_key(frontier.where("visited is null").select("crawl", "node", "score", "found"), ["crawl"], order, 1 if r == 1 else batch, "pos")
        got = chosen.join(pages, "node", "left").groupBy("crawl").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "score", "terms", "quality"))).alias("got"))  # `batch` pages at most
        going = state.where("reason is null").join(got, "crawl")
        s = F.struct(*[F.col(c) for c in _FIELDS[:-1]], F.array().cast(LOG).alias("log"))
        after = going.select("crawl", F.aggregate("got", s, lambda a, p: _visit(a, p, rules)).alias("s")).select("crawl", *[F.col("s")[c].alias(c) for c in _FIELDS])
        # crawls that ended stay in the round they ended in
        after_at = f"{folder}/tried/round={r}"
        after.write.mode("overwrite").parquet(after_at)
        after = spark.read.schema(STATE).parquet(after_at)
        if after.isEmpty():
            break
        running = after.where("reason is null").select("crawl", "log")
        visited = running.select("crawl", F.explode("log.node").alias("node")).withColumn("now", F.lit(r))
        old = frontier.join(running.select("crawl"), "crawl", "left_semi").join(visited, ["crawl", "node"], "left")
        old = old.select("crawl", "node", "score", "found", F.coalesce("visited", "now").alias("visited"))
        new = spread_join(edges, visited.select("crawl", F.col("node").alias("src")), ["src"], salt_by=["dst"])
        new = new.select("crawl", F.col("dst").alias("node"), "score", F.lit(r).alias("found"), F.lit(None).cast("int").alias("visited"))
        # an address keeps its first round; its score is a matter of the address, the best where links differ
        both = old.unionByName(new).groupBy("crawl", "node").agg(F.max("score").alias("score"), F.min("found").alias("found"), F.min("visited").alias("visited"))
        both.write.mode("overwrite").parquet(at("frontier", r))
        after.write.mode("overwrite").parquet(at("state", r))
        r += 1
    rounds = spark.read.option("basePath", f"{folder}/state").schema(f"{STATE}, round int").parquet(f"{folder}/state")
    return rounds.select("crawl", "round", F.explode("log").alias("l")).select("crawl", "round", "l.*")
