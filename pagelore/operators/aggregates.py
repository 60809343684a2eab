"""Log analytics: requests, usage, latency, monitors, caches, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import top_per_key


def request_analytics(log: DataFrame, start: Column | None = None, end: Column | None = None, ts: str = "ts",
                      by: list[str] | None = None) -> DataFrame:
    """Totals, hit rate and mean times over a date range in one pass, per key when asked."""
    d = log
    if start is not None:
        d = d.where(F.col(ts) >= start)
    if end is not None:
        d = d.where(F.col(ts) < end)
    timed = F.col("search_ms").isNotNull()
    g = d.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("cache_hit").alias("cache_hits"),
        F.avg("search_ms").alias("avg_search_ms"), F.avg(F.when(timed, F.col("total_ms"))).alias("avg_total_ms"))
    return g.withColumn("hit_rate", F.when(F.col("total") > 0, F.col("cache_hits") / F.col("total") * 100).otherwise(0.0))


def top_values(df: DataFrame, col: str, k: int = 10, n: str = "n") -> DataFrame:
    """Most frequent values, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(n)).orderBy(F.col(n).desc(), col).limit(k)


def usage_upsert(events: DataFrame, limit: Column) -> DataFrame:
    """Monthly usage per user with maps by engine and by day, and the overage.

    Counts per (user, month, engine, day) come first, so the maps are built from a few dozen rows.
    """
    base = events.groupBy("user_id", "period", "engine", "day").agg(F.count(F.lit(1)).alias("n"))
    eng = base.groupBy("user_id", "period", "engine").agg(F.sum("n").alias("n"))
    day = base.groupBy("user_id", "period", "day").agg(F.sum("n").alias("n"))
    pack = lambda d, k: d.groupBy("user_id", "period").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(k, "n")))).alias(f"by_{k}"), F.sum("n").alias("used"))
    out = pack(eng, "engine").join(pack(day, "day").drop("used"), ["user_id", "period"])
    return out.withColumn("overage", F.greatest(F.col("used") - limit, F.lit(0)))


def latency_buckets(log: DataFrame, ts: str, latency: str, error: Column, width: str = "5 minutes", exact: bool = False) -> DataFrame:
    """p50/p95/p99, request count and error share per time bucket. percentile_approx keeps a bounded
    sketch per bucket; exact percentiles are an option for reports on small ranges."""
    pct = (lambda p: F.percentile(latency, p)) if exact else (lambda p: F.percentile_approx(latency, p, 10000))
    return (log.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.avg(error.cast("double")).alias("error_share"),
                 *[pct(p / 100).alias(f"p{p}") for p in (50, 95, 99)])
            .select(F.col("w.start").alias("bucket"), "requests", "error_share", "p50", "p95", "p99"))


def monitor_summary(samples: DataFrame, by: str) -> DataFrame:
    """Totals, success share, response times, bytes, throughput and peak per second."""
    sec = samples.groupBy(by, F.col("sec")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.min("ms").alias("lo"), F.max("ms").alias("hi"),
        F.sum("ms").alias("sum_ms"), F.sum("bytes").alias("bytes"))
    return sec.groupBy(by).agg(
        F.sum("n").alias("total"), (F.sum("n_ok") / F.sum("n") * 100).alias("success_rate"), F.min("lo").alias("min_ms"),
        F.max("hi").alias("max_ms"), (F.sum("sum_ms") / F.sum("n")).alias("avg_ms"), F.sum("bytes").alias("bytes"),
        F.max("n").alias("peak_per_sec"), (F.sum("n") / (F.max("sec") - F.min("sec") + 1)).alias("throughput"))


def histogram_map(df: DataFrame, by: str, value: str, k: int | None = None) -> DataFrame:
    """Counts of a value per key as map, the k most frequent when k is given."""
    c = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    if k:
        c = top_per_key(c, [by], [F.col("n").desc(), F.col(value)], k)
    return c.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def alerts(m: DataFrame) -> DataFrame:
    """Alert codes of metric rows (cpu, memory, total, success_rate), one row each."""
    a = F.array_compact(F.array(
        F.when(F.col("cpu") > 90, "high_cpu"), F.when(F.col("memory") > 85, "high_memory"),
        F.when((F.col("total") > 10) & (F.col("success_rate") < 50), "low_success_rate")))
    return m.withColumn("alert", F.explode(a))


def recommendations(total: Column, success_rate: Column, avg_seconds: Column, worst_error_share: Column) -> Column:
    many = total > 10
    return F.array_compact(F.array(
        F.when(many & (success_rate < 70), "check_connectivity"), F.when(many & (success_rate >= 70) & (success_rate < 90), "add_retries"),
        F.when(avg_seconds > 5, "reduce_concurrency"), F.when(worst_error_share > 0.1, "frequent_error")))


def score_band(c: Column) -> Column:
    """Fixed value: five bands at 0.8, 0.6, 0.4 and 0.2."""
    return (F.when(c >= 0.8, "excellent").when(c >= 0.6, "good").when(c >= 0.4, "average").when(c >= 0.2, "poor")
            .otherwise("very_poor"))


def service_rates(log: DataFrame, service: str, ok: Column, value: str) -> DataFrame:
    g = log.groupBy(service).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.avg(value).alias("average"))
    return g.withColumn("rate", F.col("ok") / F.greatest(F.lit(1), F.col("total")))


def progress(urls: DataFrame, job: str, status: str, seconds: str, order: str, planned: str) -> DataFrame:
    """Counts, percent, rate per minute and ETA = remaining x mean of the last ten durations."""
    last = top_per_key(urls.select(job, order, seconds), [job], [F.col(order).desc()], 10).groupBy(job).agg(
        F.avg(seconds).alias("recent"))
    g = urls.groupBy(job).agg(
        F.count_if(F.col(status) == "ok").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.count_if(F.col(status) == "skipped").alias("skipped"), F.count(F.lit(1)).alias("done"),
        F.sum(seconds).alias("busy"), F.max(planned).alias("planned"))
    return g.join(last, job).select(
        job, "completed", "failed", "skipped", (F.col("done") / F.col("planned") * 100).alias("percent"),
        (F.col("done") / F.col("busy") * 60).alias("per_minute"),
        ((F.col("planned") - F.col("done")) * F.col("recent")).alias("eta_seconds"))


def credits(rerank: Column, answer: Column, production: Column, safety: Column) -> Column:
    return (F.lit(1) + rerank.cast("int") + F.when(answer, F.when(production, 2).otherwise(1)).otherwise(0)
            + safety.cast("int"))


def key_findings(text: Column, k: int | None = None) -> Column:
    """The lines (the first k, if a number is given) that start with a digit, dash or bullet and have 21 to 299 characters."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    found = F.filter(lines, lambda x: x.rlike(r"^[0-9\-•]") & (F.length(x) > 20) & (F.length(x) < 300))
    return found if k is None else F.slice(found, 1, k)


def first_seen_terms(tokens: DataFrame, doc: str, order: str, term: str = "tok") -> DataFrame:
    """New terms per document in arrival order: a term counts for the first document that has it."""
    first = tokens.groupBy(term).agg(F.min(F.struct(F.col(order).alias("at"), F.col(doc).alias("doc"))).alias("f"))
    new = first.groupBy(F.col("f.doc").alias(doc)).agg(F.count(F.lit(1)).alias("new_terms"))
    docs = tokens.groupBy(doc).agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct(term).alias("terms"))
    return docs.join(new, doc, "left").fillna(0, ["new_terms"])
