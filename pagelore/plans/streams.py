"""Structured Streaming queries: the event table (or pages) read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.skew import numbered
from ..streaming import keyed as KD
from ..streaming import tables as ST
from ..streaming.runner import drain, drain_batches, drain_updates, read_stream, use_rocksdb
from .registry import Inputs, query

K = "CAST(json_extract(props, '$.k') AS INT)"


def events(t: Inputs):
    return read_stream(t.spark, t.path("events"), t.events)


def timed(t: Inputs):
    """Events with the time in seconds, as the keyed rules want it."""
    return events(t).select("event_id", "user_id", "event_type", F.col("value").alias("seconds"), F.col("ts").cast("double").alias("at"))


@query("str_01_fixed_window", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def fixed_window(t: Inputs):
    """Fixed-window limit, two requests per user and hour (batch form)."""
    e = t.events.select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    return numbered(e, ["user_id", "hour"], F.date_trunc("minute", "ts"), [F.col("ts"), F.col("event_id")]).select("event_id", (F.col("rn") <= 2).alias("allowed"))


@query("str_01_stream_verdicts", """
SELECT event_id, row_number() OVER w <= 2 AS allowed, greatest(2 - row_number() OVER w, 0)::INT AS remaining FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id)""")
def stream_verdicts(t: Inputs):
    """The same limit as a stream, a verdict per hit from the counts of earlier batches."""
    hits = events(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("double").alias("at"))
    verdicts, _ = ST.window_limit(hits, 2, 3600)
    return verdicts.select(F.col("id").alias("event_id"), "allowed", "remaining")


@query("str_01_window_counts", """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS hits, greatest(count(*) - 2, 0)::BIGINT AS denied FROM events GROUP BY 1, 2""")
def window_counts(t: Inputs):
    """The same limit as a stream: hits and denials per tumbling window."""
    w = (events(t).withWatermark("ts", "2 hours").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("hits"))
         .select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "hits", F.greatest(F.col("hits") - 2, F.lit(0)).alias("denied")))
    return drain_updates(w, "window-counts", ["user_id", "hour"])


@query("str_02_sliding_limit", """
WITH e AS (SELECT user_id, list({'h': [epoch(ts)], 'o': [{'event_id': event_id, 'allowed': true, 'remaining': 0}]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
r AS (SELECT user_id, list_reduce(l, lambda acc, x: {'h': CASE WHEN len(list_filter(acc.h, lambda t: t > x.h[1] - 7200)) < 3 THEN list_append(list_filter(acc.h, lambda t: t > x.h[1] - 7200), x.h[1]) ELSE list_filter(acc.h, lambda t: t > x.h[1] - 7200) END,
  'o': list_append(acc.o, {'event_id': x.o[1].event_id, 'allowed': len(list_filter(acc.h, lambda t: t > x.h[1] - 7200)) < 3,
    'remaining': 3 - least(3, len(list_filter(acc.h, lambda t: t > x.h[1] - 7200)) + 1)::INTEGER})}, {'h': []::DOUBLE[], 'o': []::STRUCT(event_id BIGINT, allowed BOOLEAN, remaining INTEGER)[]}) AS f FROM e)
SELECT user_id, o.event_id, o.allowed, o.remaining FROM (SELECT user_id, unnest(f.o) AS o FROM r)""")
def sliding_limit(t: Inputs):
    """Three hits per user in two hours, sliding."""
    return drain(KD.fold(timed(t), "user_id", KD.sliding_limit(3, 7200.0, "user_id", "event_id"), ["at", "event_id"],
                         "user_id long, event_id long, allowed boolean, remaining int, reset_at double"), "sliding").drop("reset_at")


@query("str_03_token_bucket", """
WITH e AS (SELECT user_id, list({'tokens': 0.0::DOUBLE, 'last': epoch(ts), 'o': [{'event_id': event_id, 'allowed': true, 'wait': 0.0::DOUBLE}]} ORDER BY ts, event_id) AS l, min(epoch(ts)) AS t0 FROM events GROUP BY 1),
r AS (SELECT user_id, list_reduce(l, lambda acc, x: {
  'tokens': least(2.0, acc.tokens + (x.last - coalesce(acc.last, x.last)) * (1 / 7200.0::DOUBLE)) - CASE WHEN least(2.0, acc.tokens + (x.last - coalesce(acc.last, x.last)) * (1 / 7200.0::DOUBLE)) >= 1 - 1e-9 THEN 1.0 ELSE 0.0 END, 'last': x.last,
  'o': list_append(acc.o, {'event_id': x.o[1].event_id, 'allowed': least(2.0, acc.tokens + (x.last - coalesce(acc.last, x.last)) * (1 / 7200.0::DOUBLE)) >= 1 - 1e-9,
    'wait': CASE WHEN least(2.0, acc.tokens + (x.last - coalesce(acc.last, x.last)) * (1 / 7200.0::DOUBLE)) >= 1 - 1e-9 THEN 0.0
      ELSE round((1 - least(2.0, acc.tokens + (x.last - coalesce(acc.last, x.last)) * (1 / 7200.0::DOUBLE))) / (1 / 7200.0::DOUBLE), 6) END})},
  {'tokens': 2.0::DOUBLE, 'last': NULL::DOUBLE, 'o': []::STRUCT(event_id BIGINT, allowed BOOLEAN, wait DOUBLE)[]}) AS f FROM e)
SELECT user_id, o.event_id, o.allowed, o.wait FROM (SELECT user_id, unnest(f.o) AS o FROM r)""")
def token_bucket(t: Inputs):
    """Burst of two, one token per two hours."""
    return drain(KD.fold(timed(t), "user_id", KD.token_bucket(2, 1 / 7200.0, "user_id", "event_id"), ["at", "event_id"],
                         "user_id long, event_id long, allowed boolean, wait double"), "bucket")


MONITORS = {"spanish": ["/es/"], "feeds": ["utm_source"], "spam": ["spam", "pills"]}


@query("str_04_topic_monitor", """
WITH p AS (SELECT url, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS norm FROM pages)
SELECT DISTINCT monitor, norm AS url FROM p, (SELECT unnest(['spanish','feeds','spam']) AS monitor) WHERE (monitor = 'spanish' AND contains(url, '/es/')) OR (monitor = 'feeds' AND contains(url, 'utm_source')) OR (monitor = 'spam' AND (contains(url, 'spam') OR contains(url, 'pills')))""")
def topic_monitor(t: Inputs):
    """Monitors match the page stream; only addresses a monitor has never seen raise an alert, one state row per monitor and address."""
    p = read_stream(t.spark, t.path("pages"), t.pages)
    hit = F.array_compact(F.array(*[F.when(U.any_in(w, F.col("url")), F.lit(m)) for m, w in MONITORS.items()]))
    norm = F.lower(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", ""))
    m = p.select(F.explode(hit).alias("monitor"), norm.alias("url"))
    use_rocksdb(t.spark)
    return drain(m.dropDuplicates(["monitor", "url"]), "monitor")


TOPICS = ["/es/", "/fr/", "/de/", "utm_source", "spam", "pills", ".html", "page="]


@query("str_04_monitor_cycle", f"""
WITH n AS (SELECT n_name AS monitor, n_nationkey AS k, n_nationkey * 300.0::DOUBLE AS t0, (5 + n_nationkey % 7)::DOUBLE AS minutes FROM nation),
c AS (SELECT monitor, k, minutes, t0 AS tm, true AS active FROM n UNION ALL SELECT monitor, k, minutes, t0 + 3600, false FROM n WHERE k % 3 > 0 UNION ALL SELECT monitor, k, minutes, t0 + 9000, true FROM n WHERE k % 3 = 1),
s AS (SELECT *, lead(tm) OVER (PARTITION BY monitor ORDER BY tm) AS until, min(tm) OVER (PARTITION BY monitor) AS listed FROM c),
p AS (SELECT url, page_id * 60.0::DOUBLE AS tm, regexp_extract(url, '^[a-z]+://[^/?#]*?([a-z]+)(?:[/?#]|$)', 1) AS source FROM pages),
e AS (SELECT greatest((SELECT max(tm) FROM c), (SELECT max(tm) FROM p)) AS clock),
m AS (SELECT monitor, url, ceil(greatest(p.tm, s.tm) / (minutes * 60)) * (minutes * 60) AS detected_at, until FROM s JOIN p ON contains(url, {TOPICS}[(k % 8 + 1)::INT]) AND (k % 4 = 0 OR source = ['com', 'net', 'org'][(k % 3 + 1)::INT]) AND p.tm >= listed WHERE active)
SELECT monitor, url, min(detected_at) AS detected_at FROM m, e WHERE detected_at < coalesce(until, 1e300) AND detected_at <= clock GROUP BY 1, 2""")
def monitor_cycle(t: Inputs):
    """A monitor per nation that begins, pauses and resumes while pages come in; the first check of its interval tells of a page."""
    k = F.col("n_nationkey")
    begin = (k * 300).cast("double")
    word = F.element_at(F.array(*[F.lit(w) for w in TOPICS]), (k % 8 + 1).cast("int"))
    source = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (k % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    steps = F.array_compact(F.array(F.struct(begin.alias("at"), F.lit(True).alias("active")), F.when(k % 3 > 0, F.struct((begin + 3600).alias("at"), F.lit(False).alias("active"))),
                                    F.when(k % 3 == 1, F.struct((begin + 9000).alias("at"), F.lit(True).alias("active")))))
    n = read_stream(t.spark, t.path("nation"), t.nation).select(F.col("n_name").alias("monitor"), F.explode(steps).alias("c"), F.array(word).alias("words"), F.when(k % 4 == 0, none).otherwise(F.array(source)).alias("sources"), (5 + k % 7).cast("double").alias("minutes"))
    changes = n.select("monitor", "c.at", "words", "sources", "minutes", "c.active", *[F.lit(None).cast("string").alias(c) for c in ("url", "text", "source")])
    p = read_stream(t.spark, t.path("pages"), t.pages).select(F.lit(None).cast("string").alias("monitor"), (F.col("page_id") * 60).cast("double").alias("at"), F.lit(None).cast("array<string>").alias("words"),
                                                              F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("double").alias("minutes"), F.lit(None).cast("boolean").alias("active"), "url",
                                                              F.col("url").alias("text"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*?([a-z]+)(?:[/?#]|$)", 1).alias("source"))
    return ST.topic_monitors(changes.unionByName(p)).drop("batch")


@query("str_05_metrics_tumbling", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS avg_ms, count(*) FILTER (value < 10) AS fast FROM events GROUP BY 1, 2""")
def metrics_tumbling(t: Inputs):
    w = (events(t).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_ms"), F.count_if(F.col("value") < 10).alias("fast"))
         .select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "avg_ms", "fast"))
    return drain_updates(w, "metrics", ["hour", "event_type"])


@query("str_05_metrics_sliding", """
WITH s AS (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 1 HOUR, ts, INTERVAL 20 MINUTE)) AS start, ts, event_type FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM s WHERE ts >= start AND ts < start + INTERVAL 1 HOUR GROUP BY 1""")
def metrics_sliding(t: Inputs):
    w = (events(t).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour", "20 minutes").alias("w"))
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
         .select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "ok"))
    return drain_updates(w, "metrics-sliding", ["start"])


@query("str_06_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g), a AS (SELECT user_id, sid, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, sid),
c AS (SELECT user_id, sid, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS context FROM (SELECT user_id, sid, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) AS v FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_seen, n, b + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) AS closed, context FROM a JOIN c USING (user_id, sid)""")
def sessions(t: Inputs):
    """Sessions end after six idle hours; their context is the last event of every type. Those still open at the end are told too."""
    hits = events(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("double").alias("at"), F.create_map("event_type", F.col("event_id").cast("string")).alias("patch"))
    closed, open_ = ST.sessions(hits, 6 * 3600.0)
    s = closed.withColumn("closed", F.lit(True)).unionByName(open_.withColumn("closed", F.lit(False)))
    time = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    pairs = F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return s.select(F.col("key").cast("long").alias("user_id"), time("started"), time("last_seen"), F.col("hits").alias("n"), "closed", F.array_join(pairs, ",").alias("context"))


@query("str_07_task_routing", f"""
SELECT CASE event_type WHEN 'click' THEN 'scrape' WHEN 'view' THEN 'research' WHEN 'purchase' THEN 'embed' WHEN 'signup' THEN 'monitor.check' ELSE 'webhook.deliver' END AS route, count(*) AS n,
  sum(CASE WHEN event_type = 'error' THEN least(3600, 30 * (2 ** ({K} % 8))) ELSE 0 END)::BIGINT AS retry_seconds FROM events GROUP BY 1""")
def task_routing(t: Inputs):
    """Typed messages, delivered twice; each batch is routed by type and written once per message id."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "scrape", "view", "research", "purchase", "embed", "signup", "monitor.check", "error", "webhook.deliver")])
    e = events(t)
    msg = e.select("event_id", "ts", F.to_json(F.struct(F.col("event_id").alias("id"), kind[F.col("event_type")].alias("type"), (F.get_json_object("props", "$.k").cast("int") % 8).alias("attempt"))).alias("body"))
    twice = msg.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    parsed = twice.select("ts", F.from_json("body", "id long, type string, attempt int").alias("m")).select("ts", "m.*")
    once = parsed.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id"])

    def route(df, batch, out):
        delay = F.when(F.col("type") == "webhook.deliver", F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), "attempt"))).otherwise(0)
        df.select("id", "type", delay.cast("long").alias("retry_seconds")).write.mode("overwrite").partitionBy("type").parquet(f"{out}/batch={batch}")

    out = drain_batches(once, "tasks", route)
    r = t.spark.read.option("basePath", out).parquet(out)
    return r.groupBy(F.col("type").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum("retry_seconds").alias("retry_seconds"))


def delivered(kind: Column, body: Column, attempt: Column) -> Column:
    """How the messages of this query fare: a web hook succeeds from the attempt that its number asks for."""
    return (kind != "webhook.deliver") | (attempt >= body.cast("long") % 7 + 1)


@query("str_07_retries", f"""
WITH RECURSIVE m AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'scrape' WHEN 'view' THEN 'research' WHEN 'purchase' THEN 'embed' WHEN 'signup' THEN 'monitor.check' ELSE 'webhook.deliver' END AS type, {K} % 8 AS attempt, epoch(ts) AS tm FROM events),
r AS (SELECT id, type, attempt, tm, 0.0::DOUBLE AS waited FROM m
  UNION ALL SELECT id, type, attempt + 1, tm + least(3600, 30 * 2 ** attempt), waited + least(3600, 30 * 2 ** attempt) FROM r
  WHERE type = 'webhook.deliver' AND attempt < id % 7 + 1 AND attempt < 5 AND tm + least(3600, 30 * 2 ** attempt) <= (SELECT max(epoch(ts)) - 3600 FROM events)),
f AS (SELECT id, type, max(attempt) AS attempt, max(waited) AS waited FROM r GROUP BY 1, 2)
SELECT id AS event_id, type, attempt::INT AS attempt, waited, CASE WHEN type <> 'webhook.deliver' OR attempt >= id % 7 + 1 THEN 'done' WHEN attempt >= 5 THEN 'dead' ELSE 'waiting' END AS outcome FROM f""")
def retries(t: Inputs):
    """Messages that come twice and are handled once; failed web hooks come back by timers, up to the fifth attempt, and then are dead letters."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "scrape", "view", "research", "purchase", "embed", "signup", "monitor.check", "error", "webhook.deliver")])
    m = events(t).select(F.col("event_id").alias("id"), kind[F.col("event_type")].alias("type"), F.col("event_id").cast("string").alias("body"), (F.get_json_object("props", "$.k").cast("int") % 8).alias("attempt"), F.col("ts").cast("double").alias("at"))
    twice = m.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    _, last = ST.retried(twice, delivered, 3600.0)
    return last.select(F.col("id").alias("event_id"), "type", "attempt", "waited", "outcome")


@query("str_08_delivery_stream", """
WITH e AS (SELECT user_id * 100 + day(ts) AS delivery_id, epoch(ts) AS tm, event_id, event_type FROM events),
a AS (SELECT *, row_number() OVER w AS n, lead(tm) OVER w AS nxt, event_type IN ('purchase', 'view') AS ok FROM e WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY delivery_id ORDER BY tm, event_id)),
f AS (SELECT delivery_id, count(*) AS n, coalesce(min(n) FILTER (ok), 1000000) AS won,
      coalesce(min(n) FILTER (NOT ok AND n < 3 AND coalesce(nxt, (SELECT max(epoch(ts)) - 3600 FROM events)) > tm + 600 * 2 ** (n - 1) + 3600), 1000000) AS gave_up FROM a GROUP BY 1)
SELECT DISTINCT e.delivery_id::BIGINT AS delivery_id, CASE WHEN f.n IS NULL THEN 'PENDING' WHEN won <= 3 AND won <= gave_up THEN 'SENT' WHEN gave_up <= 3 OR f.n >= 3 THEN 'ABANDONED' ELSE 'FAILED' END AS state,
  coalesce(CASE WHEN won <= 3 AND won <= gave_up THEN won ELSE least(gave_up, coalesce(f.n, 0), 3) END, 0)::INT AS attempts FROM e LEFT JOIN f USING (delivery_id)""")
def delivery_stream(t: Inputs):
    """Deliveries as a stream: announced, sent, failed, and abandoned after three failures or when the timer of a retry runs out."""
    a = events(t).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("delivery_id"), F.col("event_id").alias("id"), F.col("ts").cast("double").alias("at"), F.when(F.col("event_type") != "signup", F.col("event_type").isin("purchase", "view")).alias("ok"))
    _, last = ST.deliveries(a, 3600.0, delay=600.0, grace=3600.0)
    return last.select("delivery_id", "state", "attempts")


@query("str_08_delivery_states", """
WITH a AS (SELECT user_id * 100 + day(ts) AS delivery_id, event_type IN ('purchase','view') AS ok, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS attempt FROM events),
f AS (SELECT delivery_id, min(attempt) FILTER (ok) AS won, count(*) AS n FROM a GROUP BY 1)
SELECT delivery_id::BIGINT AS delivery_id, CASE WHEN won <= 3 THEN 'SENT' WHEN n >= 3 THEN 'ABANDONED' ELSE 'FAILED' END AS state, least(coalesce(won, n), 3)::BIGINT AS attempts FROM f""")
def delivery_states(t: Inputs):
    """Attempt log to delivery state: sent by the first success within three attempts, else abandoned or to be retried."""
    a = t.events.select("event_id", "ts", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("delivery_id"), F.col("event_type").isin("purchase", "view").alias("ok"))
    a = numbered(a, ["delivery_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "attempt")
    g = a.groupBy("delivery_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.count(F.lit(1)).alias("n"))
    return g.select("delivery_id", F.when(F.col("won") <= 3, "SENT").when(F.col("n") >= 3, "ABANDONED").otherwise("FAILED").alias("state"),
                    F.least(F.coalesce("won", "n"), F.lit(3)).cast("long").alias("attempts"))


@query("str_09_usage_metering", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS engine, count(*) AS n FROM events GROUP BY 1, 2, 3")
def usage_metering(t: Inputs):
    w = (events(t).withWatermark("ts", "1 day").groupBy("user_id", F.window("ts", "1 day").alias("w"), F.col("event_type").alias("engine")).agg(F.count(F.lit(1)).alias("n"))
         .select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "engine", "n"))
    return drain_updates(w, "usage", ["user_id", "day", "engine"])


@query("str_10_cache_expiry", """
WITH e AS (SELECT user_id, list({'exp': epoch(ts), 'o': [{'event_id': event_id, 'status': ''}]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
r AS (SELECT user_id, list_reduce(l, lambda acc, x: {'exp': CASE WHEN acc.exp IS NULL OR x.exp >= acc.exp THEN x.exp + 21600 ELSE acc.exp END,
  'o': list_append(acc.o, {'event_id': x.o[1].event_id, 'status': CASE WHEN acc.exp IS NULL THEN 'miss' WHEN x.exp < acc.exp THEN 'hit' ELSE 'expired' END})},
  {'exp': NULL::DOUBLE, 'o': []::STRUCT(event_id BIGINT, status VARCHAR)[]}) AS f FROM e)
SELECT user_id, o.event_id, o.status FROM (SELECT user_id, unnest(f.o) AS o FROM r)""")
def cache_expiry(t: Inputs):
    """Cache accesses by user with a life time of six hours."""
    return drain(KD.fold(timed(t), "user_id", KD.cache_access(21600.0, "user_id", "event_id"), ["at", "event_id"], "user_id long, event_id long, status string"), "cache")


@query("str_11_change_stream", """
SELECT user_id, event_id, CASE WHEN p IS NULL THEN 'NEW' WHEN p = event_type THEN 'SAME' ELSE 'CHANGED' END AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def change_stream(t: Inputs):
    return drain(KD.fold(timed(t), "user_id", KD.change_of("user_id", "event_id", "event_type"), ["at", "event_id"], "user_id long, event_id long, status string"), "changes")


@query("str_12_job_progress", """
WITH r AS (SELECT *, row_number() OVER w AS done, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, done::INT AS done, round(done / 500 * 100, 4) AS percent, round((500 - done) * m + 1e-6, 2) AS eta_seconds FROM r""")
def job_progress(t: Inputs):
    d = drain(KD.fold(timed(t), "user_id", KD.job_progress(500, "user_id", "event_id"), ["at", "event_id"], "user_id long, event_id long, done int, percent double, eta_seconds double"), "progress")
    return d.withColumns({"percent": F.round("percent", 4), "eta_seconds": F.round(F.col("eta_seconds") + 1e-6, 2)})


@query("str_13_research_rounds")
def research_rounds(t: Inputs):
    """Sessions of several steps: each step searches with the terms its findings brought; all sessions at once."""
    from ..operators import ranking as R
    from ..operators.skew import top_per_key
    from ..session import write_and_read
    from .retrieval import bench_terms, corpus_postings
    post = corpus_postings(t)
    terms, log = bench_terms(t), None
    for step in range(1, 4):
        hits = top_per_key(R.bm25_corpus(post, terms, "doc_id", "item_id").withColumn("score", F.round("score", 6)), ["item_id"], [F.col("score").desc(), F.col("doc_id")], 3)
        hits = write_and_read(hits.withColumn("step", F.lit(step)), f"research-{step}")
        log = hits if log is None else log.unionByName(hits)
        if step < 3:
            found = post.join(hits.select("item_id", "doc_id"), "doc_id").groupBy("item_id", "tok").agg(F.sum("tf").alias("tf"))
            fresh = found.join(terms.select("item_id", "tok").distinct(), ["item_id", "tok"], "left_anti")
            terms = write_and_read(top_per_key(fresh, ["item_id"], [F.col("tf").desc(), F.col("tok")], 8).select("item_id", "tok"), f"terms-{step}")
    return log.select("item_id", "step", "doc_id", "score", "rank")


@query("src_22_outbox", """
SELECT event_id, 'hook-' || (user_id % 3) AS target, 'error on user ' || user_id AS message FROM events WHERE event_type = 'error'""")
def outbox(t: Inputs):
    """Alerts of the event stream appended to the outbox table, a folder per batch."""
    a = events(t).where("event_type = 'error'").select("event_id", F.concat(F.lit("hook-"), F.col("user_id") % 3).alias("target"), F.concat(F.lit("error on user "), "user_id").alias("message"))
    out = drain_batches(a, "outbox", lambda df, b, o: df.write.mode("overwrite").parquet(f"{o}/batch={b}"))
    return t.spark.read.option("basePath", out).parquet(out).drop("batch")
