"""Window functions over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import windows as W
from ..operators.skew import first_per_key, top_per_key
from .aggregates import LINK_SQL, page_links
from .registry import Inputs, query

SCORE_QUERY = "Attion of THANEDBLE"
# scores of internal page links: the path is one ASCII word, anchors are short
SCORES_SQL = f"""{LINK_SQL}, p AS (SELECT *, lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, string_split(host, '.') AS lab FROM links),
parts AS (SELECT *, least(1.0, len(list_intersect(['attion','thanedble'], regexp_extract_all(path, '[a-z]+'))) / 2 * 0.4 + CASE WHEN anchor <> link THEN
    len(list_intersect(['attion','thanedble'], string_split(lower(anchor), ' '))) / 2 * 0.6 ELSE 0 END) AS relevance,
  CASE WHEN regexp_matches(host, 'wikipedia.org|github.com|stackoverflow.com|mozilla.org|w3.org|ietf.org|arxiv.org|nature.com|sciencedirect.com|ieee.org') THEN 0.9
    WHEN host LIKE '%.org' THEN 0.8 WHEN host LIKE '%.com' OR host LIKE '%.net' THEN 0.6 ELSE 0.5 END * CASE WHEN len(lab) > 2 THEN 0.9 ELSE 1.0 END
    * CASE WHEN length(lab[1]) < 3 OR length(lab[1]) > 20 THEN 0.8 ELSE 1.0 END AS authority,
  greatest(0.0, least(1.0, 0.5 + CASE WHEN regexp_matches(path, 'article|post|blog|news|story|guide|tutorial') THEN 0.2 ELSE 0 END + CASE WHEN length(anchor) > 10 THEN 0.15 ELSE 0 END
    + CASE WHEN NOT regexp_matches(lower(anchor), 'link|here') THEN 0.1 ELSE 0 END + 0.05 + 0.05
    - CASE WHEN regexp_matches(lower(link), 'ads|advertisement|popup|spam|click|buy-now|discount|offer|deal') OR regexp_matches(lower(anchor), 'ads|advertisement|popup|spam|click|buy-now|discount|offer|deal') THEN 0.3 ELSE 0 END
    - CASE WHEN length(link) > 100 THEN 0.1 ELSE 0 END)) AS quality,
  least(1.0, 0.5 + CASE WHEN regexp_matches(path, '2024|2023|latest|new|recent|current') THEN 0.2 ELSE 0 END) AS freshness FROM p),
scored AS (SELECT *, relevance * 0.35 + authority * 0.25 + quality * 0.25 + freshness * 0.15 AS overall FROM parts)"""


def scored_links(t: Inputs):
    s = S.link_score(F.col("link"), F.col("anchor"), SCORE_QUERY, 2024)
    return page_links(t).withColumns({k: F.round(c, 6) for k, c in s.items()})


@query("win_01_link_rank", f"""
WITH {SCORES_SQL} SELECT page_id, link, pos::INT AS pos, round(overall, 6) AS overall, row_number() OVER (PARTITION BY page_id ORDER BY round(overall, 6) DESC, pos)::INT AS rank FROM scored""")
def link_rank(t: Inputs):
    from pyspark.sql import Window
    w = Window.partitionBy("page_id").orderBy(F.col("overall").desc(), "pos")
    return scored_links(t).select("page_id", "link", "pos", "overall", F.row_number().over(w).alias("rank"))


@query("win_02_first_occurrence", f"""
WITH {LINK_SQL} SELECT link, page_id, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM links) WHERE rn = 1""")
def first_occurrence(t: Inputs):
    return first_per_key(page_links(t).select("link", "page_id", "pos"), ["link"], [F.col("page_id"), F.col("pos")])


@query("win_03_change_status", """
SELECT o_orderkey, CASE WHEN p IS NULL THEN 'NEW' WHEN p = o_orderpriority THEN 'SAME' ELSE 'CHANGED' END AS status FROM
 (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)""")
def change_status(t: Inputs):
    d = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return W.change_status(d, ["o_custkey"], F.year("o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority").select("o_orderkey", "status")


TOK = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
NEW_SQL = f"""t AS (SELECT source, doc_id, {TOK} AS tok FROM documents), f AS (SELECT source, tok, min(doc_id) AS doc_id FROM t GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1), h AS (SELECT d.source, d.doc_id, coalesce(n, 0) AS new_terms, n_chars FROM documents d LEFT JOIN g USING (doc_id))"""


def crawl_history(t: Inputs):
    """A source is a crawl; its documents arrive by id. New terms are those the crawl had not seen."""
    from ..functions import text as X
    tok = t.spread("documents").select("source", "doc_id", F.explode(F.array_distinct(X.index_tokens(F.col("text")))).alias("tok"))
    new = tok.groupBy("source", "tok").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_terms"))
    return t.documents.select("source", "doc_id", "n_chars").join(new, "doc_id", "left").fillna(0, ["new_terms"])


def _slice():
    return F.floor(F.col("doc_id") / 100_000)


@query("win_04_saturation", f"""
WITH {NEW_SQL}, w AS (SELECT *, row_number() OVER o AS rn, avg(new_terms) OVER (PARTITION BY source ORDER BY doc_id ROWS 4 PRECEDING) AS recent FROM h WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, rn::BIGINT AS rn, round(recent, 6) AS recent, rn >= 5 AND recent < 5 AS saturated FROM w""")
def saturation(t: Inputs):
    d = W.framed(crawl_history(t), ["source"], _slice(), [F.col("doc_id")], {4: {"recent": lambda w: F.avg("new_terms").over(w)}})
    return d.select("doc_id", F.col("rn").cast("long").alias("rn"), F.round("recent", 6).alias("recent"), ((F.col("rn") >= 5) & (F.col("recent") < 5)).alias("saturated"))


@query("win_05_crawl_confidence", f"""
WITH {NEW_SQL}, w AS (SELECT doc_id, row_number() OVER o AS rn, avg(new_terms) OVER (o ROWS 2 PRECEDING) AS gain, stddev_pop(least(n_chars, 5000) / 5000) OVER (o ROWS 4 PRECEDING) AS q,
  stddev_pop(new_terms / (new_terms + 10)) OVER (o ROWS 4 PRECEDING) AS r FROM h WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, round(CASE WHEN rn > 1 THEN 0.4 * (1 - gain / 50) + 0.3 * greatest(0, 1 - q) + 0.3 * greatest(0, 1 - r) ELSE 0 END, 6) AS confidence FROM w""")
def crawl_confidence(t: Inputs):
    h = crawl_history(t).withColumns({"quality": F.least(F.col("n_chars"), F.lit(5000)) / 5000, "relevance": F.col("new_terms") / (F.col("new_terms") + 10)})
    d = W.framed(h, ["source"], _slice(), [F.col("doc_id")], {
        2: {"gain": lambda w: F.avg("new_terms").over(w)},
        4: {"q": lambda w: F.stddev_pop("quality").over(w), "r": lambda w: F.stddev_pop("relevance").over(w)}})
    z = F.lit(0.0)
    c = 0.4 * (1 - F.col("gain") / 50) + 0.3 * F.greatest(z, 1 - F.col("q")) + 0.3 * F.greatest(z, 1 - F.col("r"))
    return d.select("doc_id", F.round(F.when(F.col("rn") > 1, c).otherwise(0.0), 6).alias("confidence"))


@query("win_06_ewma", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN rn = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - rn) END), 6) AS ewma, count(*) AS n, round(sum(value * 0.5 * pow(0.5, n - rn)), 6) AS half_decay FROM r GROUP BY 1""")
def ewma(t: Inputs):
    e, o, s = t.events.select("user_id", "event_id", "ts", "value"), [F.col("ts"), F.col("event_id")], F.date_trunc("day", "ts")
    a = W.ewma(e, ["user_id"], s, o, "value", 0.1)
    b = W.ewma(e, ["user_id"], s, o, "value", 0.5, start_with_first=False).select("user_id", F.round("ewma", 6).alias("half_decay"))
    return a.withColumn("ewma", F.round("ewma", 6)).join(b, "user_id")


@query("win_06_cumulative_mean", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS cumulative_mean FROM events""")
def cumulative_mean(t: Inputs):
    d = W.cumulative_mean(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")], "value")
    return d.select("event_id", F.round("cumulative_mean", 10).alias("cumulative_mean"))


RUNS_SQL = """r AS (SELECT *, event_type NOT IN ('error','click','view') AS ok, sum((event_type NOT IN ('error','click','view'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events),
f AS (SELECT *, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) - CASE WHEN isl = 0 THEN 0 ELSE 1 END END AS runs FROM r)"""


def runs(t: Inputs):
    e = t.events.select("user_id", "event_id", "ts", "value", "event_type")
    return W.failure_runs(e, ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")], ~F.col("event_type").isin("error", "click", "view"))


@query("win_07_failure_runs", f"WITH {RUNS_SQL} SELECT event_id, runs::BIGINT AS consecutive_failures FROM f")
def failure_runs(t: Inputs):
    return runs(t).select("event_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"))


@query("win_07_health", f"""
WITH {RUNS_SQL}, l AS (SELECT user_id, arg_max(runs, rn) AS runs, arg_max(ok, rn) AS ok, arg_max(value, rn) AS secs, arg_max(event_type, rn) AS err, count(*) FILTER (ok) / count(*) * 100 AS sr, avg(value) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM f) GROUP BY 1),
s AS (SELECT *, CASE WHEN ok THEN CASE WHEN secs < 2 THEN 'healthy' WHEN secs < 5 THEN 'slow' ELSE 'unhealthy' END WHEN runs >= 10 THEN 'disabled' WHEN runs >= 5 THEN 'unhealthy' WHEN 100 - sr > 70 THEN 'unhealthy' ELSE 'unknown' END AS state FROM l)
SELECT user_id, state, round(sr / 100 * greatest(0.1, 1 - m / 10) * greatest(0.1, 1 - runs * 0.2) * CASE state WHEN 'healthy' THEN 1.0 WHEN 'slow' THEN 0.7 WHEN 'unknown' THEN 0.8 WHEN 'unhealthy' THEN 0.2 ELSE 0.0 END, 6) AS priority FROM s""")
def health(t: Inputs):
    ok = ~F.col("event_type").isin("error", "click", "view")
    g = runs(t).groupBy("user_id").agg(
        F.max_by(F.struct("consecutive_failures", ok.alias("ok"), "value", "event_type"), "rn").alias("l"),
        (F.count_if(ok) / F.count(F.lit(1)) * 100).alias("sr"), F.avg("value").alias("m"))
    st = W.health(F.col("l.consecutive_failures"), 100 - F.col("sr"), F.col("l.value"), F.col("l.ok"), F.col("l.event_type"))
    return g.withColumn("state", st).select("user_id", "state", F.round(W.priority(F.col("sr"), F.col("m"), F.col("l.consecutive_failures"), F.col("state")), 6).alias("priority"))


@query("win_08_performance_score", """
SELECT event_id, round(0.5 * avg((event_type <> 'error')::INT) OVER w + 0.3 * greatest(0, 1 - avg(value) OVER w / 30) + 0.2 * greatest(0, 1 - max(value) OVER w / 100), 6) AS score
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)""")
def performance_score(t: Inputs):
    e = t.events.select("user_id", "event_id", "ts", "value", (F.col("event_type") != "error").cast("int").alias("ok"))
    d = W.framed(e, ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")], {99: {
        "s": lambda w: F.avg("ok").over(w), "m": lambda w: F.avg("value").over(w), "p": lambda w: F.max("value").over(w)}})
    z = F.lit(0.0)
    return d.select("event_id", F.round(F.col("s") * 0.5 + F.greatest(z, 1 - F.col("m") / 30) * 0.3 + F.greatest(z, 1 - F.col("p") / 100) * 0.2, 6).alias("score"))


@query("win_09_coherence")
def coherence(t: Inputs):
    """Cosine of neighbouring sentence windows per document; checked against a plain restatement in the tests."""
    from ..functions import chunking as C
    return (t.spread("documents").select("doc_id", F.posexplode(C.coherence(C.sentence_chunks(F.col("text"), 20))).alias("idx", "similarity"))
            .withColumn("similarity", F.round("similarity", 6)))


@query("win_10_position_decay", """
SELECT event_id, round(value * (1 - 0.01 * (row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1)), 6) AS score FROM events""")
def position_decay(t: Inputs):
    """A session day is one result list; the slice is the hour, so a busy user's day is shared out."""
    from ..operators.skew import numbered
    d = numbered(t.events.select("user_id", "event_id", "ts", "value", F.to_date("ts").alias("day")), ["user_id", "day"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")])
    return d.select("event_id", F.round(F.col("value") * (1 - 0.01 * (F.col("rn") - 1)), 6).alias("score"))


@query("win_11_keep_last", """
SELECT user_id, event_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20""")
def keep_last(t: Inputs):
    return top_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20, "rn").drop("ts")


@query("win_12_moving_rate", """
WITH s AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS sec, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, sec, n, (sum(n) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))::BIGINT AS last_10s,
  (sum(n) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 599 PRECEDING AND CURRENT ROW))::BIGINT AS last_10m FROM s""")
def moving_rate(t: Inputs):
    e = t.events.select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return W.moving_rate(e, "event_type", "sec", {"last_10s": 10, "last_10m": 600})


@query("win_12_peak_rate", """
WITH s AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS sec, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT event_type, sum(n) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM s) SELECT event_type, max(m)::BIGINT AS peak_per_minute FROM r GROUP BY 1""")
def peak_rate(t: Inputs):
    e = t.events.select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return W.moving_rate(e, "event_type", "sec", {"m": 60}).groupBy("event_type").agg(F.max("m").alias("peak_per_minute"))
