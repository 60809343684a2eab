"""Streams with table state and with timers against plain versions, over several batches and with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from pagelore.session import scratch_path
from pagelore.streaming import tables as ST
from pagelore.streaming import timers as TM
from pagelore.streaming.runner import drain_updates


def as_stream(spark, batches, schema):
    """One file a batch, read in order."""
    at = scratch_path(spark, "input")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/part={k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/*")


def cut(rows, n):
    return [rows[k:k + -(-len(rows) // n)] for k in range(0, len(rows), -(-len(rows) // n))]


def test_window_limit(spark):
    rng = random.Random(1)
    hits = sorted((rng.uniform(0, 7200), k, rng.choice(["hot", "hot", "a", "b", None])) for k in range(600))
    rows = [(key, k, at) for at, k, key in hits]
    verdicts, counts = ST.window_limit(as_stream(spark, cut(rows, 4), "key string, id long, at double"), 5, 600)
    seen, want = {}, {}
    for key, k, at in rows:
        w = (key, int(at // 600))
        seen[w] = seen.get(w, 0) + 1
        want[k] = (seen[w] <= 5, max(5 - seen[w], 0))
    got = {r.id: (r.allowed, r.remaining) for r in verdicts.collect()}
    assert got == want and len({r.batch for r in verdicts.collect()}) == 4
    assert sum(r.hits for r in counts.collect()) == len(rows)
    late = [[("a", 1, 50_000.0)], [("a", 2, 10.0), ("a", 3, None), ("a", 4, 50_001.0)]]
    got = {r.id: r.allowed for r in ST.window_limit(as_stream(spark, late, "key string, id long, at double"), 5, 600)[0].collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_sessions_with_context(spark):
    rng = random.Random(2)
    hits = sorted((round(rng.uniform(0, 40_000), 3), k, rng.choice(["hot", "hot", "a", None])) for k in range(160))
    rows = [(key, k, at, {rng.choice("xyz"): str(k)} if k % 5 else None) for at, k, key in hits]
    want, open_ = [], {}
    for key, k, at, patch in rows:
        s = open_.get(key)
        if s is None or at - s[1] >= 600:
            if s:
                want.append((key, *s))
            s = open_[key] = [at, at, 0, {}]
        s[1], s[2] = at, s[2] + 1
        s[3].update(patch or {})
    newest = max(at for _, _, at, _ in rows)
    done = want + [(k, *s) for k, s in open_.items() if s[1] + 600 <= newest]
    still = [(k, *s) for k, s in open_.items() if s[1] + 600 > newest]
    closed, left = ST.sessions(as_stream(spark, cut(rows, 3), "key string, id long, at double, patch map<string,string>"), 600.0)
    plain = lambda d: sorted(map(str, [(r.key, r.started, r.last_seen, r.hits, dict(sorted(r.context.items()))) for r in d.collect()]))
    text = lambda x: sorted(map(str, [(k, a, b, n, dict(sorted(c.items()))) for k, a, b, n, c in x]))
    assert plain(closed) == text(done) and plain(left) == text(still)


def test_monitors_begin_pause_and_resume(spark):
    schema = "monitor string, at double, words array<string>, sources array<string>, minutes double, active boolean, url string, text string, source string"
    change = lambda m, at, words, active, sources=(): (m, float(at), list(words), list(sources), 2.0, active, None, None, None)
    page = lambda at, url, text, source="s": (None, float(at), None, None, None, None, url, text, source)
    first = [change("m", 0, ["cat"], True), change("n", 0, ["dog"], True, ["news"]), page(10, "u1", "a cat"), page(20, "u2", "dog", "blog"), page(130, "u3", "dog", "news")]
    second = [change("m", 200, ["cat"], False), page(250, "u4", "cat again"), page(250, "u1", "a cat"), page(500, "u5", "nothing")]
    third = [change("m", 600, ["cat"], True), change("late", 600, ["cat"], True), page(700, "u6", "cat"), page(1000, "u7", "end")]
    got = {(r.monitor, r.url): r.detected_at for r in ST.topic_monitors(as_stream(spark, [first, second, third], schema)).collect()}
    assert got == {("m", "u1"): 120.0, ("n", "u3"): 240.0, ("m", "u4"): 600.0, ("m", "u6"): 720.0, ("late", "u6"): 720.0}


def test_deliveries_with_timers(spark):
    t0 = 1_700_000_000
    rows = [(1, 1, 0, None), (1, 2, 10, True), (2, 3, 0, False), (2, 4, 50, False), (2, 5, 90, False), (2, 6, 99, True), (3, 7, 0, False), (4, 8, 5, None), (5, 9, 0, False), (5, 10, 30, True),
            (6, 11, 0, False), (6, 12, 5000, True), (9, 13, 20_000, None)] + [(7, 100 + k, k % 90, False) for k in range(400)]
    rows = [(d, i, t0 + at, ok) for d, i, at, ok in rows]
    stream = as_stream(spark, [[r for r in rows if r[2] < t0 + 60], [r for r in rows if r[2] >= t0 + 60]], "delivery_id long, id long, at long, ok boolean")
    stream = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    last = drain_updates(TM.deliveries(stream, "10 seconds", most=3, delay=60.0, backoff=2.0, grace=30.0), "deliveries", ["delivery_id"], F.col("turn"))
    got = {r.delivery_id: (r.state, r.attempts) for r in last.collect()}
    assert got == {1: ("SENT", 1), 2: ("ABANDONED", 3), 3: ("ABANDONED", 1), 4: ("PENDING", 0), 5: ("SENT", 2), 6: ("ABANDONED", 1), 7: ("ABANDONED", 3), 9: ("PENDING", 0)}


def _works(kind, body, attempt):
    return attempt >= int(body)


def test_retries_and_dead_letters(spark):
    t0 = 1_700_000_000
    rows = [(k, "hook", str(need), start, t0) for k, (need, start) in enumerate([(1, 1), (3, 1), (9, 1), (9, 6), (9, 7), (6, 6), (5, 5), (5, 1)])]
    rows += rows + [(100, "hook", "1", 1, t0 + 100_000)] + [(101, "hook", "9", 1, t0 + 99_990)]
    stream = as_stream(spark, cut(rows, 2), "id long, type string, body string, attempt int, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    every = TM.retried(stream, _works, "10 seconds", most=5, first=30.0)
    got = {r.id: (r.outcome, r.attempt, r.waited) for r in drain_updates(every, "retries", ["id"], F.col("turn")).collect()}
    assert got == {0: ("done", 1, 0.0), 1: ("done", 3, 180.0), 2: ("dead", 5, 60.0 + 120 + 240 + 480), 3: ("dead", 6, 0.0), 4: ("dead", 7, 0.0), 5: ("done", 6, 0.0), 6: ("done", 5, 0.0),
                   7: ("done", 5, 900.0), 100: ("done", 1, 0.0), 101: ("waiting", 1, 0.0)}


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty_streams(spark, rows):
    schema = "key string, id long, at double"
    verdicts, _ = ST.window_limit(as_stream(spark, [rows], schema), 5, 600)
    assert verdicts.count() == len(rows)


def test_deliveries_and_retries_with_table_state(spark):
    """the machines without a Python call per key; they agree with the timers' rules over several batches."""
    from pagelore.streaming import tables as ST
    rows = [(1, 1, 0.0, None), (1, 2, 5.0, False), (2, 3, 6.0, True), (3, 4, 7.0, False), (3, 5, 80.0, False), (3, 6, 200.0, False),
            (4, 7, 90.0, False), (1, 8, 300.0, True), (5, 9, 299.0, None), (4, 10, 310.0, None)]
    _, last = ST.deliveries(as_stream(spark, cut(rows, 3), "delivery_id long, id long, at double, ok boolean"), 10.0, delay=60.0, grace=30.0)
    got = {r.delivery_id: (r.state, r.attempts) for r in last.collect()}
    assert got == {1: ("ABANDONED", 1), 2: ("SENT", 1), 3: ("ABANDONED", 3), 4: ("ABANDONED", 1), 5: ("PENDING", 0)}
    rows = [(1, "a", "", 1, 0.0), (1, "a", "", 1, 0.0), (2, "hook", "", 1, 1.0), (3, "hook", "", 7, 2.0), (4, "hook", "", 4, 100.0), (5, "a", None, None, 400.0), (2, "hook", "", 1, 401.0)]
    ended, last = ST.retried(as_stream(spark, cut(rows, 3), "id long, type string, body string, attempt int, at double"), lambda kind, body, n: (kind == "a") | (n >= 3), 10.0)
    got = {r.id: (r.outcome, r.attempt, r.waited) for r in last.collect()}
    assert got == {1: ("done", 1, 0.0), 2: ("done", 3, 180.0), 3: ("done", 7, 0.0), 4: ("done", 4, 0.0), 5: ("done", 1, 0.0)}
    assert sorted(r.id for r in ended.collect()) == [1, 2, 3, 4, 5]


def test_sessions_compute_a_step_once(spark, monkeypatch):
    """a step that two others read was computed for each of them, 64 times in the end."""
    from pagelore.streaming import tables as ST
    kept = []
    write = ST.Scratch.write
    monkeypatch.setattr(ST.Scratch, "write", lambda self, df, name: (kept.append(name), write(self, df, name))[1])
    rows = [(f"u{i % 3}", i, float(i * 40), {"a": str(i)}) for i in range(30)]
    closed, left = ST.sessions(as_stream(spark, cut(rows, 1), "key string, id long, at double, patch map<string,string>"), 60.0)
    assert set(kept) == {"cut", "numbered", "both", "touching", "merged", "told"}
    assert closed.count() + left.count() == 30
