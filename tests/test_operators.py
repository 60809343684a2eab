"""Operators against plain restatements and hand-made fixtures."""

import hashlib
import hmac
import json
import math
import random
import re
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions import attributes as AT
from pagelore.functions import checks as C
from pagelore.functions import chunking as CH
from pagelore.functions import digests as D
from pagelore.functions import dom
from pagelore.functions import text as X
from pagelore.functions import textdiff as TD
from pagelore.functions import urls as U
from pagelore.functions.udx import ewma_udaf
from pagelore.operators import graph as G
from pagelore.operators import joins as J
from pagelore.operators import pages as P
from pagelore.operators import provenance as PV
from pagelore.operators import ranking as R
from pagelore.operators import skew as S
from pagelore.operators import vectors as V
from pagelore.operators import windows as W
from pagelore.sources import sitemaps as SM
from pagelore.streaming import keyed as KD


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first()[0]


@pytest.mark.parametrize("raw,want", [("Hello &amp; world", "Hello & world"), ("Hello <b>world</b>", "Hello world"),
                                      ("Hello    world\n\n\n", "Hello world"), (None, "")])
def test_sanitize(spark, raw, want):
    assert one(spark, raw, X.sanitize) == want


def test_sanitize_all_entities(spark):
    assert one(spark, "a &eacute; &#x41; &#66;", lambda c: X.sanitize(c, True)) == "a é A B"


@pytest.mark.parametrize("raw,want", [("https://example.com/", "https://example.com"), ("https://e.com/p?utm_source=x&b=1", "https://e.com/p?b=1"),
                                      ("https://e.com/p?a=1&gclid=2", "https://e.com/p?a=1")])
def test_normalize_url(spark, raw, want):
    assert one(spark, raw, U.normalize) == want


def test_normalize_url_strict(spark):
    assert one(spark, "https://e.com/p?utm_source=x&b=1", lambda c: U.normalize(c, True)) == "https://e.com/p&b=1"


def test_truncate(spark):
    out = one(spark, "This is a long text that goes on", lambda c: X.truncate_words(c, 20))
    assert len(out) <= 20 and out.endswith("...")
    assert one(spark, "Short", lambda c: X.truncate_words(c, 20)) == "Short"


def test_hmac(spark):
    rows = [("msg " * n, "k" * (n * 13 % 100 + 1)) for n in range(1, 20)]
    got = spark.createDataFrame(rows, "m string, k string").select("m", "k", D.hmac_sha256_hex(F.col("m"), F.col("k")).alias("s")).collect()
    for r in got:
        assert r.s == hmac.new(r.k.encode(), r.m.encode(), hashlib.sha256).hexdigest()


def split_sentences(t):
    pat = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<![A-Z][A-Z]\.)(?<=[.!?])\s+")
    return [s.strip() for s in pat.split(t) if s.strip()]


TEXTS = ["One short. Two is here! Is three? " * 3 + "Dr. Who met e.g. nobody. " + "word " * 600 + ". End of it all now.",
         "Para one is long enough to be kept as it is, surely so.\n\n" + "Sentence number twenty is right here. " * 90 + "\n\nshort",
         "x" * 1050, "The cat sat on a mat. The cat ate fish. " * 20 + "Stars shine over distant galaxies. Planets orbit bright stars. " * 20]


def test_sentence_chunks(spark):
    def plain(t, least=10):
        out, cur = [], None
        for s in split_sentences(t):
            if cur is None:
                cur = s
            elif len(cur) < least * 2:
                cur += " " + s
            else:
                out.append(cur)
                cur = s
        out += [cur] if cur else []
        return [s for s in out if len(s) >= least]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", CH.sentence_chunks(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [plain(t) for t in TEXTS]


def test_fixed_chunks_and_tail(spark):
    t = "x" * 1050
    assert [len(c) for c in one(spark, t, CH.fixed_chunks)] == [1000, 150]
    assert [len(c) for c in one(spark, "y" * 1850, CH.fixed_chunks)] == [1000, 950, 50]
    assert [len(c) for c in one(spark, "y" * 1850, lambda c: CH.fixed_chunks(c, drop_tail=True))] == [1000, 950]


def test_paragraph_and_hybrid_limits(spark):
    for t in TEXTS:
        for c in one(spark, t, CH.hybrid_chunks):
            assert len(c) <= 2001
    assert all(len(c) >= 50 for c in one(spark, TEXTS[1], CH.paragraph_chunks))


def test_coherence(spark):
    stop = set(CH.TOPIC_STOP)

    def vocab(s):
        d = {}
        for w in re.findall(r"\w+", s.lower()):
            if len(w) > 2 and w not in stop:
                d[w] = d.get(w, 0) + 1
        return d

    def cos(a, b):
        n = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return sum(v * b.get(k, 0) for k, v in a.items()) / n if n else 0.0

    sents = split_sentences(TEXTS[3])
    win = [vocab(" ".join(sents[i:i + 3])) for i in range(len(sents) - 2)]
    want = [cos(a, b) for a, b in zip(win, win[1:])]
    got = spark.createDataFrame([(sents,)], "s array<string>").select(CH.coherence(F.col("s")).alias("o")).first()[0]
    assert np.allclose(got, want)


def test_quality(spark):
    t = TEXTS[1]
    clean = re.sub(r"\s+", " ", t).strip()
    ws = clean.split()
    per = len(ws) / len(split_sentences(clean))
    band = 1.0 if 15 <= per <= 20 else 0.8 if 10 <= per <= 30 else 0.5
    div = min(1, len({w.lower() for w in ws if len(w) > 3}) / (len(ws) * 0.5))
    alnum = sum(c.isalnum() or c.isspace() for c in clean) / len(clean)
    assert one(spark, t, X.quality_score) == pytest.approx((min(1, len(ws) / 500) + band + div + alnum) / 4)
    assert one(spark, "five words are not many", X.quality_score) == pytest.approx(0.05)


def test_snippet(spark):
    t = "Nothing here. " * 30 + "The quick brown fox jumps. " + "Tail text. " * 30
    d = spark.createDataFrame([(t, "fox quick"), (t, "zz"), ("short", "x")], "t string, q string")
    a, b, c = [r[0] for r in d.select(X.snippet(F.col("t"), F.col("q"))).collect()]
    assert a == "The quick brown fox jumps." and b == t[:200] + "..." and c == "short"


def skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}", i, rnd.random(), rnd.random() < 0.3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i long, v double, ok boolean")


def test_numbered_and_running_total(spark):
    rows, df = skewed(spark)
    sl = F.floor(F.col("i") / 100)
    got = {r.i: (r.rn, r.s) for r in S.running_total(S.numbered(df, ["k"], sl, [F.col("i")]), ["k"], sl, [F.col("i")], {"s": F.col("v")}).collect()}
    seen = {}
    for k, i, v, _ in rows:
        n, s = seen.get(k, (0, 0.0))
        seen[k] = (n + 1, s + v)
        assert got[i][0] == n + 1 and got[i][1] == pytest.approx(s + v)


def test_row_frame_previous_and_failures(spark):
    rows, df = skewed(spark)
    sl = F.floor(F.col("i") / 150)
    f = W.framed(df, ["k"], sl, [F.col("i")], {4: {"m": lambda w: F.avg("v").over(w)}}, block=16)
    got = {r.i: r.m for r in f.collect()}
    prev = {r.i: r.prev_i for r in S.previous_row(df, ["k"], sl, [F.col("i")], ["i"]).collect()}
    runs = {r.i: r.consecutive_failures for r in W.failure_runs(df, ["k"], sl, [F.col("i")], F.col("ok")).collect()}
    hist, streak = {}, {}
    for k, i, v, ok in rows:
        h = hist.setdefault(k, [])
        assert prev[i] == (h[-1][0] if h else None)
        h.append((i, v))
        assert got[i] == pytest.approx(np.mean([x for _, x in h[-5:]]))
        streak[k] = 0 if ok else streak.get(k, 0) + 1
        assert runs[i] == streak[k]


def test_spread_join_and_nested(spark):
    rows, df = skewed(spark)
    right = df.select("k").distinct().withColumn("n", F.length("k"))
    assert S.spread_join(df, right, ["k"], salt_by=["i"]).count() == len(rows)
    with pytest.raises(ValueError):
        S.spread_join(df, right, ["k"], salt_by=["k"])
    many = spark.range(2500).select(F.lit("hot").alias("k"), "id").unionByName(spark.range(3).select(F.lit("cold").alias("k"), "id"))
    got = {r.k: r["items"] for r in S.nested(many, ["k"], F.col("id"), F.col("id")).collect()}
    assert got == {"hot": list(range(2500)), "cold": [0, 1, 2]}


def test_components_of_a_long_chain(spark):
    chain = spark.range(2200).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("src"), F.lpad((F.col("id") + 1).cast("string"), 5, "0").alias("dst"))
    assert {r.component for r in G.components(chain).collect()} == {"00000"}


def test_robots_groups(spark):
    body = "User-agent: *\nUser-agent: other\nDisallow: /a\nAllow: /a/b?x=\n\nUser-agent: third\nDisallow: /\n"
    rules = SM.robots_rules(spark.createDataFrame([("h.org", body)], "host string, body string"))
    pages = spark.createDataFrame([("https://h.org/a/1",), ("https://h.org/a/b?x=1#f",), ("https://h.org/a/b?y",), ("https://h.org/c",), ("https://none.org/a",)], "url string")
    got = {r.url: r.allowed for r in SM.allowed_by_robots(pages, rules).collect()}
    assert list(got[u] for u in ("https://h.org/a/1", "https://h.org/a/b?x=1#f", "https://h.org/a/b?y", "https://h.org/c", "https://none.org/a")) == [False, True, False, True, True]
    other = SM.robots_rules(spark.createDataFrame([("h.org", body)], "host string, body string"), "Other")
    assert {r.url: r.allowed for r in SM.allowed_by_robots(pages, other).collect()} == got


def test_ewma_forms_agree(spark):
    rows, df = skewed(spark, 500)
    a = {r.k: r.ewma for r in W.ewma(df, ["k"], F.floor(F.col("i") / 50), [F.col("i")], "v").collect()}
    b = {r.k: r.e for r in df.groupBy("k").agg(ewma_udaf()(F.col("i"), F.col("v")).alias("e")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_entity_matching(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "iota"]
    ents = [("name", " ".join(rnd.sample(words, rnd.choice([5, 6, 6]))), f"u{i % 7}") for i in range(60)] + [("name", "12", "u1"), ("name", "12 ", "u2")]

    def toks(v):
        return {w for w in v.lower().split() if w.isalpha() and len(w) > 1}

    def match(a, b):
        ta, tb = toks(a), toks(b)
        return a.lower().strip() == b.lower().strip() or bool(ta and tb and len(ta & tb) / len(ta | tb) > 0.8)

    want = sum(match(a[1], b[1]) for i, a in enumerate(ents) for b in ents[i + 1:] if a[2] != b[2])
    got = J.cross_reference_matches(spark.createDataFrame(ents, "entity_type string, value string, source_url string")).collect()
    assert [(r.entity_type, r.matches) for r in got] == [("name", want)]


def test_containment(spark):
    vals = ["ab", "abc", "xabcx", "b", "zz", "abcz", "Q"]
    ents = [("t", v, f"u{i}") for i, v in enumerate(vals)] + [("t", "abc", "u9")]
    got = {(r.short, r.long) for r in J.contained_values(spark.createDataFrame(ents, "entity_type string, value string, source_url string")).collect()}
    low = {v.lower() for v in vals}
    assert got == {(a, b) for a in low for b in low if a != b and a in b}


def test_bm25_library_rule(spark):
    docs = [(i, t.split()) for i, t in enumerate(["apple banana apple", "banana cherry", "banana banana date fig", "banana"])]
    n, avg = 4, np.mean([len(t) for _, t in docs])
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    want = {}
    for i, t in docs:
        for w in ("banana", "apple", "apple"):
            tf = t.count(w)
            if tf:
                want[i] = want.get(i, 0) + idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    d = spark.createDataFrame(docs, "doc long, t array<string>")
    q = spark.createDataFrame([(1, "banana"), (1, "apple"), (1, "apple")], "q int, tok string")
    got = {r.doc: r.score for r in R.bm25_corpus(R.postings(d, ["doc"], F.col("t")), q, "doc", "q").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.9, 0.1, 0.0]), (8, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = V.search(base, q, 2).collect()
    assert {r.id for r in got if r.query_id == 9 and r["rank"] == 1} == {1} and 4 not in {r.id for r in got}
    assert [r.id for r in V.search(base, q.where("query_id = 8"), 5, 0.9).collect()] == [1]


def test_similar_pairs_exact(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[50:60] = m[0] + rng.normal(scale=0.01, size=(10, 8))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.9}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    got = {(r.a, r.b) for r in V.similar_pairs(df, 0.9, n_pivots=6, block_rows=40).collect()}
    assert got == want


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "a"), ("e", "f"), ("f", "g"), ("x", "y"), ("y", "z")]


def test_crawls(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in G.breadth_first(e, s, 3).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2, "f": 3}
    cc = {r.node: r.component for r in G.components(e).collect()}
    assert {cc[n] for n in "abcdefg"} == {"a"} and {cc[n] for n in "xyz"} == {"x"}
    sc = e.withColumn("score", F.when(F.col("dst") == "c", 0.9).when(F.col("dst") == "e", 0.8).otherwise(0.5))
    best = G.best_first(sc, s.withColumn("crawl", F.lit("1")), batch=1, max_pages=4).orderBy("round").collect()
    assert [r.node for r in best] == ["a", "c", "e", "b", "d"]
    o = e.withColumn("ord", F.ascii("dst"))
    dfs = G.depth_first(o, s.withColumn("ord", F.lit(0)), 3).orderBy("path").collect()
    assert [r.node for r in dfs] == ["a", "b", "d", "c", "e", "f"]


TABLE = """<table><caption>C</caption><thead><tr><th>A</th><th>B</th><th>C</th></tr></thead><tbody><tr><td>1 one</td><td>2 two</td><td>3</td></tr>
<tr><td>4</td><td><a href="/x">five</a></td><td>6</td></tr><tr><td colspan=2>seven</td><td>8</td></tr></tbody></table><table class="layout"><tr><td>a</td><td>b</td></tr></table>"""


def page(spark, html):
    return dom.parse_pages(spark.createDataFrame([(1, "https://e.org/d/p", html)], "page_id long, url string, html string"))


def test_tables(spark):
    t = P.tables(page(spark, TABLE))
    assert [r.score for r in P.table_scores(t).orderBy("table_no").collect()] == [17, 0]
    r = P.table_rows(t).orderBy("table_no").first()
    assert r.valid and r.headers == ["A", "B", "C"] and [c.text for c in r.rows[2]] == ["seven", "", "8"]
    assert r.rows[1][1].links[0].url == "https://e.org/x"


def test_parser_recovers(spark):
    d = page(spark, "<ul><li>a<li>b</ul><p>one<p>two<script>var x='</p>';</script><b>open")
    n = d.first().nodes
    assert [x.tag for x in n].count("li") == 2 and [x.tag for x in n].count("p") == 2
    assert d.first().body_text == "abonetwoopen"


def test_blocks_and_pruning(spark):
    html = "<body><nav><p>menu words that are long enough to count here</p></nav><article class='content'><h1>Title of the page here</h1><p>Short.</p><p>This paragraph has enough words to be a text block.</p></article></body>"
    b = P.blocks(page(spark, html)).collect()
    assert [(r.tag, r.score) for r in b] == [("article", 11), ("h1", 10), ("p", 3)]
    k = {r.tag: r["keep"] for r in P.prune(P.blocks(page(spark, html))).collect()}
    assert k == {"article": True, "h1": True, "p": False}


def test_cache_rules_and_masks(spark):
    got = [one(spark, u, lambda c: C.cache_rule(c, [{"pattern": "*", "mode": "a", "priority": 0}, {"pattern": "domain:e.org", "mode": "b", "priority": 2},
                                                    {"pattern": "pdf", "mode": "c", "priority": 5}])[0]) for u in ("https://x.com/", "https://s.e.org/", "https://e.org/a.pdf")]
    assert got == ["a", "b", "c"]
    assert one(spark, "https://u:p@127.0.0.1:80/x", U.is_safe) is False
    assert one(spark, "-3.5 km", AT.numeric) == -3.5


def test_text_diff(spark):
    d = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "o string, n string").select(TD.diff_lines("o", "n").alias("d"), TD.change_percentage("o", "o").alias("p")).first()
    assert [(x.kind, x.line, x.content) for x in d.d] == [("delete", 2, "b"), ("add", 2, "x"), ("add", 4, "d")] and d.p == 0


def test_change_tracking(spark):
    v = [("u", 1, "T", "w " * 200), ("u", 2, "T", "w " * 200), ("u", 3, "T", "w " * 200 + "z " * 90), ("u", 4, "N", "w " * 200 + "z " * 90)]
    d = spark.createDataFrame(v, "url string, ts int, title string, text string")
    r = PV.track_changes(d, ["url"], F.col("ts"), F.lit(0)).orderBy("ts").collect()
    assert [x.status for x in r] == ["NEW", "SAME", "CHANGED", "CHANGED"]
    assert "word_count_change" in r[2].significant and r[3].significant == ["title_changed"]


def test_signatures_match_hmac(spark):
    row = {"v": 1, "url": "https://e/\u00e9/\U0001f600\"q\\\\", "fetched_at": datetime(2024, 1, 31), "content_sha256": "s", "content_type": "text/html", "content_bytes": 7, "snapshot_key": "k",
           "engine": "e", "agent_run_id": None, "api_key_id": "a", "signed_at": datetime(2024, 2, 1, 10, 20, 30, 500), "signing_key_id": "A", "signing_alg": "HMAC-SHA256"}
    types = ", ".join(f"{k} {'int' if isinstance(v, int) else 'timestamp' if isinstance(v, datetime) else 'string'}" for k, v in row.items())
    env = spark.createDataFrame([tuple(row.values())], types)
    keys = spark.createDataFrame([("A", "secret")], "signing_key_id string, secret string")
    s = PV.sign(env, keys)
    body = json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in row.items()}, separators=(",", ":"), sort_keys=True)
    assert s.first().signature == hmac.new(b"secret", body.encode(), hashlib.sha256).hexdigest()
    assert PV.verify(s, keys).first().status == "valid"
    changed = [s.withColumn(f, {"int": F.lit(9), "timestamp": F.lit("2020-01-01").cast("timestamp")}.get(dict(s.dtypes)[f], F.lit("x"))).withColumn("changed", F.lit(f)) for f in PV.ENVELOPE_FIELDS]
    got = {r.changed: r.status for r in PV.verify(reduce(DataFrame.unionByName, changed), keys).collect()}
    assert got == {f: "unknown_key" if f == "signing_key_id" else "invalid" for f in PV.ENVELOPE_FIELDS}


def fold(step, rows):
    st, out = {}, []
    for r in rows:
        out += step(st, r)
    return out


def test_limits():
    s = KD.sliding_limit(3, 60.0, "k", "i")
    got = fold(s, [{"k": "a", "i": i, "at": float(t)} for i, t in enumerate([0, 10, 20, 30, 61, 62])])
    assert [g[2] for g in got] == [True, True, True, False, True, False]
    b = KD.token_bucket(2, 0.1, "k", "i")
    got = fold(b, [{"k": "a", "i": i, "at": float(t)} for i, t in enumerate([0, 0, 0, 10])])
    assert [g[2] for g in got] == [True, True, False, True]
    c = fold(KD.cache_access(10.0, "k", "i"), [{"k": "a", "i": i, "at": float(t)} for i, t in enumerate([0, 5, 11, 12])])
    assert [g[2] for g in c] == ["miss", "hit", "expired", "hit"]
    u = fold(KD.unseen(2, "k", "v"), [{"k": "a", "v": x} for x in "xxyzx"])
    assert [g[1] for g in u] == ["x", "y", "z", "x"]


def test_sliding_limit_stream(spark):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    got = {r.event_id: r.allowed for r in entry.queries()["str_02_sliding_limit"](spark, folder).collect()}
    ev = pd.read_parquet(f"{folder}/events.parquet").sort_values(["ts", "event_id"])
    for _, g in ev.groupby("user_id"):
        rows = [{"user_id": r.user_id, "event_id": r.event_id, "at": r.ts.timestamp()} for r in g.itertuples()]
        for x in fold(KD.sliding_limit(3, 7200.0, "user_id", "event_id"), rows):
            assert got[x[1]] == x[2]


def test_topic_monitor_never_forgets(spark, tmp_path):
    """An address comes back after 1100 others of its monitor: no second alert."""
    from pagelore.plans import streams
    from pagelore.plans.registry import Inputs

    urls = [f"http://h/es/{k}" for k in range(1101)] + ["http://h/es/0?x=1", "http://h/es/0/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.monitor, r.url) for r in streams.topic_monitor(Inputs(spark, str(tmp_path))).collect()]
    assert sorted(got) == sorted(("spanish", f"http://h/es/{k}") for k in range(1101))
