"""What must not grow with the tables: broadcasts through the driver, and rows of the input that go missing or come twice."""

import random

from pagelore.operators import graph as G
from pagelore.operators import joins as J
from pagelore.operators import skew as S
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_spread_join_are_not_broadcast(spark):
    left, right = spark.range(1000).withColumn("v", F.col("id") * 2), spark.range(50)
    j = S.spread_join(left, right, ["id"], salt_by=["v"])
    assert "Broadcast" not in plan(j) and j.count() == 50


def test_year_of_an_address_is_its_last_one(spark):
    from pagelore.functions.scoring import year_score
    d = spark.createDataFrame([("https://e.org/en/2043/2014/x",), ("https://e.org/2043",), ("https://e.org/a",)], "u string")
    assert [r[0] for r in d.select(F.round(year_score(F.col("u"), 2024), 6)).collect()] == [0.0, 1.0, 0.5]


def test_every_page_of_a_linked_address_is_scored(spark):
    links = spark.createDataFrame([(1, "u"), (2, "v")], "page_id int, link string")
    pages = spark.createDataFrame([(1, "u", "feed", True), (2, "u", "none", True), (3, "u", "feed", False), (4, "v", "feed", False)], "page_id int, url string, title string, ok boolean")
    assert sorted(tuple(r) for r in G.enriched_links(links, pages, "feed").select("page_id", "score").collect()) == [(1, 0.0), (1, 1.0), (2, 0.0)]


def test_character_references_end_in_a_semicolon(spark):
    from pagelore.functions import dom
    from pagelore.functions.text import unescape_one
    p = dom.parse_one('<title>a &amp;&amp</title><p title="x&lty &lt;">&copy 1 &copy; &#65;&#65 &nosuch; &</p><script>a && b &amp; c</script>')
    assert p["text"] == "a &&amp&copy 1 © A&#65 &nosuch; &"
    assert dict(p["nodes"][1]["attrs"]) == {"title": "x&lty <"} and p["nodes"][2]["raw"] == "a && b &amp; c"
    assert unescape_one("&lt;b&gt &eacute;&ampx; &") == "<b&gt é&ampx; &"


def test_pages_of_one_address_are_compared_each_with_itself(spark):
    from pagelore.operators.provenance import citation_diff
    snap = spark.createDataFrame([(1, "u", "a", 10), (2, "u", "b", 20), (3, "u", "c", 30)], "page_id int, url string, content_sha256 string, n_bytes int")
    got = citation_diff(snap, snap.where("page_id < 3"), ["page_id", "url"]).select("status").collect()
    assert sorted(r[0] for r in got) == ["missing_live", "unchanged", "unchanged"]


def test_quotations_support_without_negations(spark):
    from pagelore.operators.provenance import verdicts
    docs = spark.createDataFrame([(1, "It is not so. One two three four five.")], "doc_id int, text string")
    claims = spark.createDataFrame([(7, "One two three four five.")], "item_id int, text string")
    e = spark.createDataFrame([(7, 1, 1.0)], "item_id int, doc_id int, containment double")
    assert verdicts(e, docs, claims, "item_id", "doc_id", negations=()).first()["verdict"] == "supported"
    assert verdicts(e, docs, claims, "item_id", "doc_id").first()["verdict"] == "contradicted"


def test_input_addresses_come_once_per_page(spark, tmp_path):
    from pagelore.plans.registry import Inputs
    from pagelore.plans.sets import input_urls
    spark.createDataFrame([(1, "https://e.org/de/1"), (2, "https://e.org/de/1"), (3, "https://e.org/en/1")], "page_id int, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1,)], "doc_id int").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[0] for r in input_urls(Inputs(spark, str(tmp_path))).collect()] == ["https://e.org/de/1"] * 2


def test_main_content_prefers_an_article_to_a_block_as_long(spark):
    from pagelore.functions import dom
    from pagelore.operators.pages import main_content
    d = spark.createDataFrame([(f"<div>{'b' * 60}</div><article>{'a' * 60}</article>",)], "html string")
    assert dom.parse_pages(d).select(main_content()).first()[0] == "a" * 60


def test_pages_are_parsed_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from pagelore.functions import dom
    v = pa.array(["<p class='x'>a<b>b</b></p>" * 20] * 1000 + [None])
    tracemalloc.start()
    out = dom.parse_html.func(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1001 and out[1000].as_py() == {"text": "", "nodes": []} and peak < 4 << 20
    assert len(dom.parse_html.func(pa.array([], pa.string()))) == 0


def test_postings_of_token_sets_carry_no_texts(spark):
    """the rare tokens of a set travelled with its whole text; pairs are those of brute force."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    near = [[t for t in b if rng.random() > 0.08] + rng.choice([[], ["x"]]) for b in base for _ in range(3)]
    sets = sorted({tuple(sorted(set(b))) for b in [*base, *near] if b})
    df = spark.createDataFrame([("line", i, list(x)) for i, x in enumerate(sets)], "entity_type string, id long, toks array<string>")
    assert not any(f.dataType.typeName() == "array" for f in J._prefixes(df, 0.8).schema.fields)
    want = {(i, k) for i, a in enumerate(sets) for k, b in enumerate(sets) if i < k and 10 * len(set(a) & set(b)) > 8 * len(set(a) | set(b))}
    assert len(want) > 20
    assert {(r.id_a, r.id_b) for r in J.similar_sets(df, 0.8).collect()} == want


def test_rows_of_a_table_are_extracted_once(spark):
    """A filter on the check of a table repeated the extraction, for each column that it reads."""
    from pagelore.functions import dom
    from pagelore.operators import pages as P
    html = "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>first</td><td>second</td></tr><tr><td>third</td><td>fourth</td></tr></tbody></table>"
    t = P.tables(dom.parse_pages(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")))
    out = P.table_rows(t).where("valid AND size(headers) = 2").select("page_id", "headers", "rows")
    optimized = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("lambda" in line for line in optimized if line.lstrip(" :+-").startswith("Filter") and "_once" in line)
    assert sum("_once" in line and "Generate" in line for line in optimized) == 3
    assert [[c["text"] for c in row] for row in out.first()["rows"]] == [["first", "second"], ["third", "fourth"]]


def test_words_of_a_text_are_not_shuffled(spark, tmp_path):
    """tokens went through an exchange when the table was read as it is; the text goes through one instead."""
    from pagelore.operators import ranking as R
    from pagelore.plans.registry import Inputs
    spark.createDataFrame([(i, "red green blue green") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    p = R.postings(Inputs(spark, str(tmp_path)).by_id("documents"), ["doc_id"], R.query_tokens(F.col("text")))
    assert plan(p).count("Exchange hashpartitioning") == 1
    assert p.where("tok = 'green' AND tf = 2").count() == 40


def shuffled_rows(df):
    """Rows that the exchanges of a plan wrote, after it has run."""
    df.collect()
    p = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    leaves, n = p.collectLeaves(), 0
    for i in range(leaves.size()):
        m = leaves.apply(i).plan().metrics() if "QueryStage" in leaves.apply(i).nodeName() else None
        n += m.apply("shuffleRecordsWritten").value() if m is not None and m.contains("shuffleRecordsWritten") else 0
    return n


def test_periods_of_usual_keys_are_shuffled_once(spark, monkeypatch):
    """every period of every key went to sixteen copies; now those of hot keys do, which are still spread."""
    facts = [(k, u, k % 7) for k, u in enumerate([1] * 900 + [u for u in range(2, 402)] + [None])]
    facts = spark.createDataFrame(facts, "fact long, user long, day int").repartition(3)
    periods = spark.createDataFrame([(u, a, a + 2) for u in range(0, 402) for a in (0, 3)] + [(None, 0, 9), (1, 1, 4)], "user long, start int, end int")
    every = periods.collect()
    want = [(f.fact, p.start) for f in facts.collect() for p in every if f.user is not None and f.user == p.user and p.start <= f.day < p.end]
    small = J.interval_join(facts, periods, ["user"], "day", "start", "end", salt_by=["fact"])
    assert sorted((r.fact, r.start) for r in small.collect()) == sorted(want)
    assert shuffled_rows(small) <= facts.count() + periods.count()
    monkeypatch.setattr(S, "HOT_ROWS", 100)
    hot = J.interval_join(facts, periods, ["user"], "day", "start", "end", salt_by=["fact"])
    assert sorted((r.fact, r.start) for r in hot.collect()) == sorted(want) and len(want) > 1000
    assert periods.count() < shuffled_rows(hot) - facts.where("user is not null").count() + 10 <= periods.count() + 3 * 15 + 20


def test_words_of_windows_are_counted_once(spark):
    """F32: each distinct word of a window was looked for in all of its words, so long sentences took their square."""
    import time
    from collections import Counter

    from pagelore.functions import chunking as C
    rng = random.Random(32)
    sents = [[f"word{rng.randrange(12000)}" for _ in range(8000)] for _ in range(6)]
    d = spark.createDataFrame([([" ".join(s) for s in sents],), (["one two"] * 3,), (None,)], "s array<string>").repartition(1)
    began = time.time()
    got = [r[0] for r in d.select(C.coherence(F.col("s"))).collect()]
    assert time.time() - began < 20
    c = [Counter(w for s in sents[i:i + 3] for w in s) for i in range(4)]
    n = [sum(x * x for x in v.values()) ** 0.5 for v in c]
    want = [sum(v * c[i + 1][k] for k, v in c[i].items()) / (n[i] * n[i + 1]) for i in range(3)]
    assert sorted(map(len, got)) == [0, 0, 3] and max(abs(a - b) for a, b in zip(max(got, key=len), want, strict=True)) < 1e-12


def test_texts_for_topics_come_in_pieces_of_bounded_size(spark, monkeypatch, tmp_path):
    """F32: a table of less than a full split per core kept two tasks per core, however long they became."""
    from pagelore.plans import chunks, registry
    rng = random.Random(7)
    texts = [("".join(rng.choice("abcdefgh ") for _ in range(4000)),) for _ in range(3000)]
    spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = registry.Inputs(spark, str(tmp_path))
    two = t.by_id("documents", piece=100_000).rdd.getNumPartitions()
    assert two > 2 * t.spread("documents").rdd.getNumPartitions()
    assert "REPARTITION_BY_NUM" in plan(chunks.topics(t)) and "REPARTITION_BY_COL" not in plan(chunks.topics(t))


def test_blocks_of_vectors_are_shuffled_not_vectors(spark):
    """each vector went to every block that it is compared with; now blocks do, as one row each, and every pair of blocks meets once."""
    import numpy as np
    from pagelore.operators import vectors as V
    r = np.random.default_rng(31)
    m = r.normal(size=(300, 8)).astype(np.float32)
    m[40], m[41] = 0, m[7]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    m = m.astype(np.float64)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    for threshold in (0.4, 0.9, -0.1):
        s = np.round(u @ u.T, 6)
        want = sorted((i, j, s[i, j]) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= threshold and 41 not in (i, j))
        got = V.similar_pairs(df, threshold, n_pivots=6, block_rows=40)
        assert sorted((x.a, x.b, x.similarity) for x in got.collect()) == want and len(want) > 5
        assert shuffled_rows(got) < 1000


def test_nodes_of_pages_leave_the_worker_a_few_pages_at_a_time(spark):
    """a worker held the nodes of a whole Arrow batch, ten thousand pages or more bytes than it may have."""
    from pagelore.functions import dom
    from pyspark.sql import types as T
    d = spark.createDataFrame([(i, f"<p id='{i}'>t{i}</p>" if i else None) for i in range(100)], "page_id long, html string").coalesce(1)
    p = dom.parse_pages(d)
    assert "MapInArrow" in plan(p) and "ArrowEvalPython" not in plan(p)
    assert p.schema["nodes"].dataType == T.ArrayType(dom.NODE)
    assert sorted((r.page_id, r.body_text, len(r.nodes)) for r in p.collect()) == [(0, "", 0), *((i, f"t{i}", 1) for i in range(1, 100))]


def test_pairs_of_equal_vectors_are_listed(spark, tmp_path, monkeypatch):
    """vec_07_similar_pairs listed one row of equal vectors alone; its SQL lists every pair of rows."""
    import __spark_entry__ as entry
    import duckdb
    import numpy as np
    from pagelore.operators import vectors as V
    r = np.random.default_rng(7)
    m = r.normal(size=(400, 8)).astype(np.float32)
    m[::5], m[1:60:3], m[302] = m[0], m[1], m[301]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(400, None), (0, m[9].tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["vec_07_similar_pairs"]).fetchall())
    assert sorted(tuple(x) for x in entry.queries()["vec_07_similar_pairs"](spark, str(tmp_path)).collect()) == want
    # a vector of many rows, entries of few ids, several blocks
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    monkeypatch.setattr(V, "ENTRY_IDS", 8)
    got = V.similar_pairs(df.select(F.col("vec_id").alias("id"), "embedding"), 0.4, n_pivots=6, block_rows=40, copies=True)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 3000
    # few pairs at once: entries (1, 2), (3), (4, 5, 6) among themselves
    monkeypatch.setattr(V, "OUT_ROWS", 4)
    side = np.array([0, 2, 3, 6]), np.array([1, 2, 3, 4, 5, 6])
    i, j = np.triu_indices(3)
    parts = list(V._products(i, j, np.ones(6), side, side))
    assert len(parts) > 3 and sorted((a, b) for p in parts for a, b in zip(p["a"], p["b"], strict=True)) == [(a, b) for a in range(1, 7) for b in range(a + 1, 7)]


def test_clusters_of_blocks_shuffle_texts_alone(spark):
    """terms, and both sides of the joins over them, were shuffled and written; now a page's texts go to its row once."""
    from pagelore.operators.clusters import page_clusters
    rows = [(p, b, " ".join(f"w{p + b // 2 * 40 + k}" for k in range(30)), 30) for p in range(20) for b in range(10)]
    d = spark.createDataFrame(rows, "page_id long, block int, text string, words int")
    got = page_clusters(d)
    assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got)
    assert {(r.page_id, r.cluster, r.n_blocks, r.words, r["rank"]) for r in got.collect()} == {(p, c, n, n * 30, c // 2 + 1) for p in range(20) for c, n in ((0, 2), (2, 2), (4, 2))}


def test_simple_markup_takes_the_short_way(spark, monkeypatch):
    """every page went through the general parser, node by node as dicts; most of the time of the table queries."""
    import pyarrow as pa
    from pagelore.functions import dom
    simple = ["", "a &amp; b &lt", "<p>Order</p><table class='data'><caption>Order 1</caption><thead><tr><th>Line<tbody><tr><td colspan=2>x<td><a href=\"/part/1?a=1&amp;b\">P</a></table>",
              "<!DOCTYPE html><html><head><title>t &copy;</title><style></style><script>var a = '</p>';</script></head><body><!-- ad 5 --><br/><img src='x'><P ID=q Id='r'>é</body></html>",
              "<ul><li>a<li>b</ul></p><dl><dt>x<dd>y</dl>", None]
    other = ["<p", "a < b", "<a href=x/>", "<a title=\"a>b\">", "<!-- a<b -->", "<noscript><p>x</noscript>", "<script>x", "<script>a</script >", chr(0xE000), "<x-y>", "<a b = 'c'>"]
    want = pa.array([dom.parse_one(p) for p in simple + other], dom._ARROW)
    text, nodes = dom._parsed(simple + other)
    assert text.to_pylist() == want.field("text").to_pylist() and nodes.to_pylist() == want.field("nodes").to_pylist()
    assert nodes.type == want.field("nodes").type and all(dom._simple_rows(p) is None for p in other)
    monkeypatch.setattr(dom, "parse_one", None)
    assert len(dom._parsed(simple)[0]) == len(simple)


def test_rooted_links_and_headers(spark):
    """all parts of an address were looked for in every link, and the head row for every cell."""
    from pagelore.functions import dom
    from pagelore.functions import urls as U
    from pagelore.operators import pages as P
    refs = ["/part/1", "/a?b=/../c#d", "/a/../b?q", "/a/./b", "//h.org/x", "/", "/a.b", "/.hidden", " /x y ", "/a\nb"]
    d = spark.createDataFrame([(r,) for r in refs], "r string").select(U.resolve(F.lit("https://e.org/l/p?q#f"), F.col("r")).alias("u"))
    assert [r.u for r in d.collect()][:9] == ["https://e.org" + u for u in ("/part/1", "/a?b=/../c#d", "/b?q", "/a/b")] + ["https://h.org/x"] + ["https://e.org" + u for u in ("/", "/a.b", "/.hidden", "/x y")]
    t = P.tables(dom.parse_pages(spark.createDataFrame([(1, "u", "<table><thead><tr><th>a</th></tr></thead></table>")], "page_id int, url string, html string")))
    rows = P.table_rows(t).select("headers")
    assert rows.first().headers == ["a"] and rows._jdf.queryExecution().optimizedPlan().toString().count("isnotnull(thead#") == 1


def test_ranked_lines_leave_no_token_in_the_shuffle(spark, tmp_path):
    """tokens of the lines were counted four times, sorted and shuffled for three joins; they are now counted in the row of their document."""
    import __spark_entry__ as entry
    import duckdb
    from pagelore.plans import registry, retrieval
    rng = random.Random(4)
    docs = [(i, "\n".join(" ".join(rng.choice("alpha beta gamma delta epsilon the of 12 kappa lambda omega".split()) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(60, ""), (61, None), (62, "12 of the"), (63, "alpha"), (64, "\n\nBETA  beta\tbeta\n\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha alpha omega"), (1, "beta kappa the"), (2, "12")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert shuffled_rows(retrieval.inside_scores(registry.Inputs(spark, str(tmp_path)))) < 200
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("ret_06_bm25_blocks", "ret_13_highlights"):
        want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.select(*[d[0] for d in con.execute(entry.oracle_sql()[name]).description]).collect()) == want and len(want) > 50


def test_tokens_and_texts_of_mentions_are_not_shuffled(spark):
    """every token of every text was shuffled twice, and the texts with each group and each mention; rows of one id may come many times."""
    rng = random.Random(6)
    base = [" ".join(f"w{'abcdefgh'[rng.randrange(8)]}{'abcdefgh'[rng.randrange(8)]}" for _ in range(rng.randrange(3, 25))).replace("w", "x") for _ in range(40)]
    texts = [" ".join(w for w in b.split() if rng.random() > 0.05) for b in base for _ in range(3)] + ["12", " 12"]
    ents = spark.createDataFrame([(k, t, f"u{i % 9}") for i, t in enumerate(texts * 3) for k in ("a", "b")[:1 + i % 2]], "entity_type string, value string, source_url string")
    e = J.entity_groups(ents)
    sets = e.where(F.size("toks") > 0).select("entity_type", "id", "toks")
    assert "Exchange" not in plan(e) and "Join" not in plan(J._prefixes(sets, 0.8)) and plan(J._prefixes(sets, 0.8)).count("Exchange") == 1
    rows = [(r.entity_type, r.source_url, bytes(r.id), frozenset(r.toks)) for r in e.collect()]
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1:] if x[0] == y[0] and (x[2] == y[2] or 10 * len(x[3] & y[3]) > 8 * len(x[3] | y[3]))]
    want = {(min(x[2], y[2]), max(x[2], y[2]), x[0]) for x, y in pairs if x[2] != y[2]}
    assert {(bytes(r.id_a), bytes(r.id_b), r.entity_type) for r in J.similar_sets(sets, 0.8).collect()} == want and len(want) > 10
    got = {r.entity_type: r.matches for r in J.cross_reference_matches(ents).collect()}
    assert got == {k: sum(x[0] == k and x[1] != y[1] for x, y in pairs) for k in "ab"}
