"""Content normal forms, signed envelopes, change tracking, claims, credibility, quotas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import text as X
from ..functions.textdiff import change_percentage
from ..session import path_exists, write_and_read
from .skew import nested, numbered, previous_row, spread_join, top_per_key


def normal_text(c: Column) -> Column:
    """Line ends stripped, outer whitespace dropped, one final newline."""
    t = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)[ \t\x0B\f]+$", "")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def normal_html(body_text: Column) -> Column:
    """Visible text of a parsed page (scripts, styles and comments are not in it) with single blanks."""
    return X.squeeze(body_text)


# The signed fields of an envelope, and what a missing column counts as.
ENVELOPE_FIELDS = ("v", "url", "fetched_at", "content_sha256", "content_type", "content_bytes", "snapshot_key", "engine", "agent_run_id", "api_key_id",
                   "signed_at", "signing_key_id", "signing_alg")
ENVELOPE_DEFAULTS = {"v": 1, "content_type": "text/html", "agent_run_id": None, "api_key_id": None, "signing_alg": "HMAC-SHA256"}


def with_envelope_fields(df: DataFrame) -> DataFrame:
    """Adds the fields that have a default; any other missing field is an error of the plan."""
    return df.withColumns({c: F.lit(v) if v is not None else F.lit(None).cast("string") for c, v in ENVELOPE_DEFAULTS.items() if c not in df.columns})


def envelope_body(df: DataFrame) -> Column:
    """Canonical JSON of all fields but the signature: sorted keys, no blanks, nulls kept, ASCII, times in ISO form."""
    return D.canonical_object({c: F.col(c) for c in ENVELOPE_FIELDS}, dict(df.dtypes))


def sign(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds the signature: HMAC of the canonical JSON under the key named by signing_key_id (signing_key_id, secret)."""
    d = with_envelope_fields(df)
    # few keys, many envelopes: each key's envelopes are spread over several tasks
    j = spread_join(d, keys.select("signing_key_id", "secret"), ["signing_key_id"], salt_by=["url"])
    return j.withColumn("signature", D.hmac_sha256_hex(envelope_body(d), F.col("secret"))).drop("secret")


def verify(envelopes: DataFrame, keys: DataFrame) -> DataFrame:
    """status: valid, invalid, or unknown_key; rotated keys stay usable as long as they are in the table."""
    d = with_envelope_fields(envelopes)
    j = spread_join(d, keys.select("signing_key_id", "secret"), ["signing_key_id"], "left", salt_by=["url"])
    ok = D.signature_ok(envelope_body(d), F.col("secret"), F.col("signature"))
    return j.withColumn("status", F.when(F.col("secret").isNull(), "unknown_key").when(ok, "valid").otherwise("invalid")).drop("secret")


def citation_diff(snapshots: DataFrame, live: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """(url, sha, n_bytes) against the live form: missing_live, unchanged or changed with byte difference and ratio.
    `on` tells pages apart where several share an address."""
    l = live.select(*on, F.col("content_sha256").alias("live_sha"), F.col("n_bytes").alias("live_bytes"))
    j = snapshots.join(l, list(on), "left")
    status = F.when(F.col("live_sha").isNull(), "missing_live").when(F.col("live_sha") == F.col("content_sha256"), "unchanged").otherwise("changed")
    diff = F.when(status == "unchanged", 0).when(status == "changed", F.abs(F.col("n_bytes") - F.col("live_bytes")))
    ratio = F.when(diff.isNotNull(), F.round(F.least(diff / F.greatest(F.col("n_bytes"), F.lit(1)), F.lit(1.0)), 4))
    return j.select("url", status.alias("status"), diff.alias("byte_diff"), ratio.alias("changed_ratio"))


def track_changes(versions: DataFrame, keys: list[str], order: Column, slice_col: Column, threshold: float = 5.0) -> DataFrame:
    """Status against the version before, changed percent, significant changes and whether to notify.

    Versions carry title and text. The text comparison runs on changed rows only.
    """
    d = versions.withColumn("hash", F.sha2(F.concat_ws("\x1f", "title", "text"), 256))
    p = previous_row(d, keys, slice_col, [order], ["hash", "title", "text"])
    st = F.when(F.col("prev_hash").isNull(), "NEW").when(F.col("prev_hash") == F.col("hash"), "SAME").otherwise("CHANGED")
    p = p.withColumn("status", st)
    changed = F.col("status") == "CHANGED"
    p = p.withColumn("changed_percent", change_percentage(F.when(changed, F.col("prev_text")), F.when(changed, F.col("text"))))
    old_n, new_n = X.word_count(F.col("prev_text")), X.word_count(F.col("text"))
    pct = F.round("changed_percent", 1).cast("string")
    sig = F.array_compact(F.array(
        F.when(F.col("prev_title") != F.col("title"), "title_changed"),
        F.when((F.col("prev_text") != "") & (F.col("text") != ""), F.when(F.col("changed_percent") > 20, F.concat(F.lit("major_text_change_"), pct, F.lit("%")))
               .when(F.col("changed_percent") > 5, F.concat(F.lit("minor_text_change_"), pct, F.lit("%")))),
        F.when(F.abs(old_n - new_n) > F.greatest(F.lit(10), old_n * 0.1), "word_count_change")))
    return p.withColumn("significant", F.when(changed, sig).otherwise(F.array().cast("array<string>"))).withColumn(
        "notify", changed & (F.col("changed_percent") >= threshold)).drop("prev_title", "prev_text")


NEGATIONS = ("not", "no", "never", "false", "hoax", "deny", "denied", "incorrect", "untrue")


def claim_evidence(claims: DataFrame, docs: DataFrame, claim_id: str, doc_id: str, size: int = 5) -> DataFrame:
    """(claim, doc, shared, total, containment): share of the claim's word shingles found in the document.

    The claims' shingles are written, so Spark knows their size: if small, they go to the tasks that cut the documents,
    and only shingles of some claim are ever shuffled; if large, both sides are shuffled by shingle.
    """
    def grams(c):
        return X.let(X.index_tokens(c), lambda w: F.when(F.size(w) >= size, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))))
            .otherwise(F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))))

    c = claims.select(F.col(claim_id), grams(F.col("text")).alias("g"))
    total = c.select(claim_id, F.size("g").alias("total"))
    q = c.select(claim_id, F.explode("g").alias("gram"))
    d = docs.select(doc_id, F.explode(grams(F.col("text"))).alias("gram"))
    hit = d.join(write_and_read(q, "grams"), "gram").groupBy(claim_id, doc_id).agg(F.count(F.lit(1)).alias("shared"))
    return hit.join(total, claim_id).withColumn("containment", F.col("shared") / F.col("total"))


def verdicts(evidence: DataFrame, docs: DataFrame, claims: DataFrame, claim_id: str, doc_id: str, k: int | None = None, support: float = 0.5, chars: int | None = None,
             negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """The evidence on both sides, or on one without `negations` (the best k of each and snippets of so many characters only if numbers are given) and the verdict."""
    d = evidence.where(F.col("containment") >= support).join(docs.select(doc_id, F.col("text").alias("body")), doc_id).join(claims.select(claim_id, "text"), claim_id)
    at = F.greatest(F.instr(F.lower("body"), F.lower(F.substring_index("text", " ", 5))), F.lit(1))
    around = F.substring(F.col("body"), F.greatest(at - 80, F.lit(1)), F.lit(80))
    neg = F.exists(X.index_tokens(around), lambda w: w.isin(*negations)) & ~F.exists(X.index_tokens(F.col("text")), lambda w: w.isin(*negations))
    e = d.select(claim_id, doc_id, "containment", at.alias("offset"), F.substring(F.col("body"), at, F.lit(chars) if chars else F.length("body")).alias("snippet"),
                 F.when(neg, "against").otherwise("for").alias("side"))
    if k is not None:
        e = top_per_key(e, [claim_id, "side"], [F.col("containment").desc(), F.col(doc_id)], k).drop("rank")
    g = e.groupBy(claim_id).agg(F.count_if(F.col("side") == "for").alias("n_for"), F.count_if(F.col("side") == "against").alias("n_against"), F.max("containment").alias("best"))
    # in parts: a claim that everything quotes has a long list
    g = g.join(nested(e, [claim_id], F.struct("side", (-F.col("containment")).alias("order"), doc_id, "offset", "snippet"), F.col(doc_id), "evidence"), claim_id)
    v = F.when(F.col("n_for").isNull() | (F.col("n_for") + F.col("n_against") == 0), "unverified").when(F.col("n_against") > F.col("n_for"), "contradicted") \
        .when((F.col("n_against") > 0), "mixed").otherwise("supported")
    return claims.select(claim_id).join(g, claim_id, "left").withColumn("verdict", v).withColumn("confidence", F.coalesce(F.col("best"), F.lit(0.0)))


def credibility(docs: DataFrame, labels: DataFrame, source: str, doc_id: str, text: str, seen_at: str | None = None, now: Column | None = None, old_days: float = 365.0) -> DataFrame:
    """Score 0-100 per source from text quality, label share and duplicate share; 50/unknown without labels.

    With `seen_at`, when a document was first seen, and `now`, a source also gains up to 10 points with the age of its oldest
    document, in full at `old_days`.
    """
    aged = seen_at is not None and now is not None
    d = docs.select(source, doc_id, F.md5(text).alias("h"), F.least(F.length(text), F.lit(5000)).alias("len"), *([F.col(seen_at).cast("timestamp").alias("seen")] if aged else []))
    j = d.join(labels, doc_id, "left")
    age = [F.greatest(F.lit(0.0), (now.cast("timestamp").cast("double") - F.min(F.col("seen").cast("double"))) / 86400).alias("age_days")] if aged else []
    base = j.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.avg("quality").alias("good"), F.avg("toxic").alias("bad"), (F.avg("len") / 5000).alias("quality"), *age)
    dup = d.groupBy(source, "h").agg(F.count(F.lit(1)).alias("c")).groupBy(source).agg((1 - F.count(F.lit(1)) / F.sum("c")).alias("duplicate_share"))
    older = 10 * F.least(F.lit(1.0), F.coalesce(F.col("age_days"), F.lit(0.0)) / old_days) if aged else F.lit(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 40 * F.col("good") + 30 * F.col("quality") + 30 * (1 - F.col("duplicate_share")) - 20 * F.col("bad") + older))
    out = base.join(dup, source)
    return out.withColumn("score", F.when(F.col("labelled") == 0, 50.0).otherwise(score)).withColumn(
        "level", F.when(F.col("labelled") == 0, "unknown").when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low"))


def kept_fresh(folder: str, wanted: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], now: datetime, valid_days: float = 7.0) -> DataFrame:
    """The table of computed rows below `folder`, with those of `wanted` (key) that it lacks or that have run out computed anew.

    `compute` gets the keys to compute and returns one row per key. Rows carry computed_at and valid_until. A call writes the next
    version of the table, a folder of its own: what is still valid is taken over, and what nobody wants goes when it runs out.
    """
    spark = wanted.sparkSession
    version = 0
    while path_exists(spark, f"{folder}/version={version}/_SUCCESS"):
        version += 1
    at = F.lit(now).cast("timestamp")
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    old = spark.read.parquet(f"{folder}/version={version - 1}").where(F.col("valid_until") > at) if version else None
    missing = keys if old is None else keys.join(old.select(key), key, "left_anti")
    fresh = compute(missing).withColumns({"computed_at": at, "valid_until": at + F.make_dt_interval(secs=F.lit(valid_days * 86400.0))})
    (fresh if old is None else old.unionByName(fresh.select(*old.columns))).write.mode("overwrite").parquet(f"{folder}/version={version}")
    return spark.read.parquet(f"{folder}/version={version}")


def unsafe(c: Column, terms: list[str]) -> Column:
    """Any listed word as a whole word."""
    return F.exists(X.index_tokens(c), lambda w: w.isin(terms))


def quota(log: DataFrame, keys: list[str], slice_col: Column, order: list[Column], limit: Column) -> DataFrame:
    """Decision per request: allowed while its number within the period is within the limit; remaining."""
    d = numbered(log, keys, slice_col, order, "used")
    return d.withColumn("allowed", F.col("used") <= limit).withColumn("remaining", F.greatest(limit - F.col("used"), F.lit(0)))
