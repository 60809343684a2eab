"""Operators with Python stages: token files, SimHash, decontamination, page templates, classifier, pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagelore.llm import decontamination, factorisation, html_template, shingle_overlap, simhash, token_output
from pagelore.llm.eliasfano import EliasFano
from pagelore.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [7] * 600, list(range(1000)), [2**62, 2**62 + 1], [0, 2**40]])
def test_elias_fano(values):
    rng = random.Random(1)
    for v in (values, sorted(rng.randrange(10**6) for _ in range(3000)), sorted(rng.randrange(50) for _ in range(2000))):
        data = b"xx" + EliasFano.encode(v).to_bytes() + b"yy"
        e, end = EliasFano.from_bytes(data, 2)
        assert end == len(data) - 2 and e.decode().tolist() == v
        assert [e.select(k) for k in range(len(v))] == v
        with pytest.raises(IndexError):
            e.select(len(v))
    n = 10_000
    assert len(EliasFano.encode(np.arange(n) * 500).to_bytes()) < n * (2 + 9 + 1) / 8 + 100


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "a \n b", "it's we'll", "x\u00a0y z", "\u2003 q", "tab\there is", "<|endoftext|> a b", "é à ü ñ", "\U0001f600 \U0001f600", "a\x1c b", "\x1c\x1c a",
         "    lead", "trail    ", "1 2 3 44 555", "a\r\n\r\nb c  d", "\n\n", "x" * 3000, "don't stop 'now' now", "a b.\nC d,\ne.\nF\n\nG h\n. i\n, j", "x foo\nbar.\nBaz! q foo\nbar."]


def test_encoder():
    t, e = Tokenizer.from_file(VOCABULARY), token_output.Encoder(VOCABULARY, room=20)
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["a", " ", " ", "  ", "\n", "é", "'s", "9", "the", "\u2009", "!", "\t", ".", ",", "\r"]) for _ in range(40)) for _ in range(400)]
    for k in range(0, len(mixed), 7):
        some = TEXTS + mixed[k:k + 7]
        for text, got in zip(some, e.encode(some), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    rows = [(k * 10 - 50, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (30, "again"), (30, "again"), (10**12, None)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    to = scratch_path(spark, "tokens")
    index = token_output.write_tokens(d.repartition(6), to, VOCABULARY, shard_tokens=50)
    assert index.count() > 3
    t = Tokenizer.from_file(VOCABULARY)
    got = token_output.read_tokens(spark, to).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
    names = [r.doc_id for r in got]
    assert names[:2] == [None, None] and names[2:] == sorted(names[2:])
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows)
    for r in token_output.token_digests(spark, to).collect():
        assert any((r.start, r.n_tokens) == (g.start, g.n_tokens) and r.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got)
    f = index.orderBy("start").first()
    shard = token_output.Shard(token_output._get(f"{to}/files", f.file))
    assert [(shard.doc_id(k), *shard.span(k)) for k in range(shard.n)] == list(shard.documents())
    to = scratch_path(spark, "tokens")
    token_output.write_tokens(d.limit(0), to, VOCABULARY)
    assert token_output.token_digests(spark, to).count() == 0


def plain_components(fps, radius=3):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "One two"), (-4, "one TWO"), (-5, "x"), (-6, " \n"), (-7, "É é"), (-8, "é É")]
    d = d.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    fps = {r.doc_id: plain_fingerprint(r.text) for r in d.collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    want = plain_components(fps)
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}
    assert got[-1].fingerprint == "0" * 16
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [[(list(range(0, 32)), 1), (list(range(32, 64)), 1)], [(list(range(0, 64, 3)), 1), (list(range(1, 64, 3)), 0), (list(range(2, 64, 3)), 0)],
                                   [(list(range(k, 64, 4)), 0) for k in range(4)]])
def test_links_find_every_pair(spark, monkeypatch, parts):
    """Thresholds of any shape, and keys that are cut into blocks, connect what brute force connects."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(500):
        c = centres[min(19, int(rng.expovariate(0.5)))]
        for _ in range(rng.randrange(7)):
            c ^= 1 << rng.randrange(64)
        fps.add(c)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(table, parts)).collect()}
    want = plain_components({f: f & (1 << 64) - 1 for f in signed})
    assert {f: root.get(f, f) for f in signed} == want


def test_plan_of_thresholds(spark):
    assert simhash.allocate([[0, 5, 9, 9, 9], [0, 1, 2, 9, 9]], 2) == (9, [1, 1]) or simhash.allocate([[0, 5, 9, 9, 9], [0, 1, 2, 9, 9]], 2)[0] == 9
    table = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    parts = simhash.plan(table)
    assert sum(t for _, t in parts) + sum(-1 for _ in range(0)) <= 3 and len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)


def edits(a, b):
    """Least edits between a and any substring of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeionrtls") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 30)))) for k in range(12)] + [(12, "x"), (13, None), (14, "  "), (15, "Same Text here twice"), (16, "same text here twice")]
    docs = [(0, None), (1, ""), (2, "x"), (3, "SAME  text\nhere twice")]
    for k in range(4, 200):
        text = [word() for _ in range(rng.randrange(40))]
        body = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(int(len(body) * 0.14) + 2)):
            at = rng.randrange(len(body))
            kind = rng.randrange(3)
            if kind == 0:
                body[at] = rng.choice("xyz")
            elif kind == 1:
                body.insert(at, "q")
            elif len(body) > 1:
                del body[at]
        text.insert(rng.randrange(len(text) + 1), "".join(body))
        docs.append((k, " ".join(text)))
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, b).collect()}
    for i, text in docs:
        for j, item in items:
            a, t = decontamination.normal(item), decontamination.normal(text)
            least = edits(a, t) if a and t else None
            hit = least is not None and least <= int(len(a) * decontamination.RATE)
            assert hit == ((i, j) in got), (i, j, least)
            if hit:
                r = got[i, j]
                assert r.distance == least and edits(a, t[r.start:r.end]) == least
    held = {i for i, _ in got}
    assert {r.doc_id for r in decontamination.clean(d, b).collect()} == {i for i, _ in docs} - held
    assert decontamination.contaminated(d.limit(0), b).count() == 0 and decontamination.contaminated(d, b.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 30)
    items = spark.createDataFrame([(k, f"item number {k} of the block") for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"here is item number {k} of the block indeed") for k in range(12)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, rate=0.0).collect()}
    assert got == {(k, k) for k in range(9)}


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">A {k}</a></li></ul></nav><!-- ad --><div class="ad">Buy {k}</div><div class="cookie-notice">Cookies</div><p>Always here</p>
<article><h1>Title&amp; {k}</h1><p>First <b>bold</b>
 line<br>more {k}<p>Second&nbsp;&eacute; {k}<ul><li>one {k}<li>two {k}</ul><form><input>Send</form><aside>Side</aside><p hidden>no</p>
<section class="comments"><p>Nice!</p></section></article><div id="sidebar">S</div><footer>&copy; {k}</footer></body></html>"""


def test_main_text(spark):
    pages = [(k, f"http://h/{k}", PAGE.format(k=k)) for k in range(15)]
    pages += [(100, "http://h/x", None), (101, "http://h/y", ""), (102, None, "plain &lt;text&gt;"), (103, "http://z/", "<article><p>open <i>ended<p>next &#233;"), (104, "http://z/1", "<p>a</p><nav>n</nav><div>b<div>c</div>d</div>"),
              (105, "http://z/2", "<main><p>m</p></main><p>out</p>"), (106, "http://z/3", "<script>x</script>"), (107, "http://z/4", "a < b <p title='x>y'>c</p> <!-- never closed")]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, blocks string")
    got = {r.page_id: r for r in html_template.main_text(d).collect()}
    for k in range(15):
        assert got[k].text == f"Title& {k}\nFirst bold line more {k}\nSecond é {k}\none {k}\ntwo {k}"
        assert got[k].n_chars == len(got[k].text)
    assert [got[k].text for k in range(100, 108)] == ["", "", "plain <text>", "open ended\nnext é", "a\nb\nc\nd", "m", "", "a < b\nc"]
    assert html_template.main_text(d.limit(0)).count() == 0


def test_template_classes(spark):
    body = "<body><div><p>{k} own words</p><p>Sign up for our letter</p></div><p>{k} end</p></body>"
    rows = [(k, f"http://h/{k}", body.format(k=k)) for k in range(20)] + [(100 + k, "http://copies/", body.format(k=0)) for k in range(30)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.main_text(d).collect()}
    assert got[3] == "3 own words\n3 end"  # the block that every page shares is template
    assert got[101] == "0 own words\nSign up for our letter\n0 end"  # copies of one page make no template
    t = html_template.template(html_template.parsed(d))
    assert {r.host for r in t.collect()} == {"h"} and t.where("is_text").count() == 1


def test_factorisation_identity():
    rng = np.random.default_rng(5)
    m = factorisation.Model(0.3, rng.normal(size=factorisation.DIMENSIONS).astype(np.float32), rng.normal(size=(factorisation.DIMENSIONS, factorisation.RANK)).astype(np.float32))
    slots, values = factorisation.features("some words and some more words!", 31)
    pairs = sum(float(m.factors[a] @ m.factors[b]) * float(x) * float(y) for i, (a, x) in enumerate(zip(slots, values)) for b, y in list(zip(slots, values))[i + 1:])
    assert abs(m.margin(slots, values) - (0.3 + float(m.linear[slots] @ values) + pairs)) < 1e-3


def test_quality_classifier(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in factorisation.judge(d, labels).collect()}
    assert len(got) == d.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for _, r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    right = sum(q == r.predicted for q, r in held) / len(held)
    assert right > 0.93, right
    odd = spark.createDataFrame([(None, None, None, "clash"), (1, "", 0, "clash"), (2, "x" * 100_000, None, "clash")], "doc_id long, text string, n_chars long, score string")
    assert all(0 <= r.score <= 1 and (r.doc_id is not None or not r.held_out) for r in factorisation.judge(odd, labels).collect())
    none = factorisation.judge(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert factorisation.judge(odd.limit(0), labels).count() == 0


def test_pipeline(spark):
    """Each stage against a plain version, on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept, dedup, clean, mixed, tokens = (f for _, f in corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    one = kept(spark, docs, FOLDER)
    assert one.columns == columns
    ids = {r.doc_id for r in one.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in good) > 0.97 * len(good)

    extra = docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5"))
    two = dedup(spark, docs.unionByName(extra), FOLDER)
    want = jaccard_components({i: r.text for i, r in rows.items()})
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(set(want.values()))

    three = clean(spark, docs, FOLDER)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    exact = {i for i, r in rows.items() if any(decontamination.normal(x) in decontamination.normal(r.text) for x in items)}
    left = {r.doc_id for r in three.collect()}
    assert three.columns == columns and not exact & left and len(left) >= len(rows) - len(exact) - 3

    four = mixed(spark, docs, FOLDER)
    assert four.columns == columns and 1.3 * docs.count() < four.count() < 1.7 * docs.count()

    five = tokens(spark, four, FOLDER).collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.select("doc_id").collect())
    assert corpus_pipeline.run(spark, FOLDER).count() > 50


def jaccard_components(texts, width=5):
    """Links of every pair of distinct texts whose shingles overlap by 0.8, by brute force."""
    def of(x):
        w = (x or "").encode().lower().split()
        return frozenset(b" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, ids = {i: of(x) for i, x in texts.items()}, sorted(texts)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("hot", "block"), [(64, 256), (2, 2)])
def test_pipeline_removes_overlaps_of_four_fifths(spark, monkeypatch, hot, block):
    """The stage keeps what brute-force Jaccard keeps: copies many bits apart go, texts below 0.8 stay."""
    monkeypatch.setattr(shingle_overlap, "HOT", hot)
    monkeypatch.setattr(shingle_overlap, "BLOCK", block)
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    passage = [f"p{k}" for k in range(30)]
    texts = ["", None, " \n", "One two", "one TWO", "x"]
    for _ in range(60):  # copies around the threshold, chains, and a passage that all quote
        w = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w + passage * rng.randrange(2)))
    texts += [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]) for _ in range(30)]
    extra = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    d = d.unionByName(extra, allowMissingColumns=True)
    rows = {r.doc_id: r.text for r in d.collect()}
    want = jaccard_components(rows)
    assert 30 < sum(i != c for i, c in want.items()) < 90
    assert {r.doc_id: r.component_id for r in shingle_overlap.near_duplicates(d).collect()} == want
    got = corpus_pipeline.STAGES[1][1](spark, d, FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert shingle_overlap.near_duplicates(d.limit(0)).count() == 0


def test_pipeline_searches_fingerprints(spark, monkeypatch):
    """the stage went past the search of op4. It is asked, each fingerprint within three bits is met, and no link below 0.8 comes of it."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rng, scratch = random.Random(5), shingle_overlap.Scratch(spark)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in rng.sample(range(400), 30)] + ["a b c d e f", "A b c d e F"]
    d = d.unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    sets = {}
    for r in d.collect():
        h = shingle_overlap.shingles(r.text)
        sets[h.tobytes()] = (simhash.of_hashes(h), set(h.tolist()))
    rows = shingle_overlap._sets(d, np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = rows.groupBy("fp").agg(F.any_value("sim").alias("sim")).cache()
    sim_of = {r.fp: r.sim for r in first.collect()}
    assert sorted(sim_of.values()) == sorted(s for s, _ in sets.values())
    groups = {}
    for a, b in shingle_overlap._by_fingerprint(first, scratch).collect():
        groups.setdefault(a, {a}).add(b), groups.setdefault(b, {b}).add(a)
    seen = {}
    for x in groups:  # components of what was found
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen[y] = x
                todo += groups[y]
    near = [(a, b) for a in sim_of for b in sim_of if a < b and ((sim_of[a] ^ sim_of[b]) & (2**64 - 1)).bit_count() <= 3]
    assert len(near) > 30 and all(seen[a] == seen[b] for a, b in near)
    scratch.clear()
    asked = []
    search = shingle_overlap._by_fingerprint
    monkeypatch.setattr(shingle_overlap, "_by_fingerprint", lambda *a: asked.append(1) or search(*a))
    got = corpus_pipeline.STAGES[1][1](spark, d, FOLDER)
    want = jaccard_components({r.doc_id: r.text for r in d.collect()})
    assert asked and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_pipeline_judges_texts_of_one_id_apart(spark):
    """An id with two texts, one a copy of a smaller id's: the other text stays, once; ids that name two groups keep both."""
    t = {k: " ".join(f"{k}{i}" for i in range(20)) for k in "abcd"}
    rows = [(1, t["a"]), (2, t["a"]), (2, t["b"]), (2, t["b"]), (3, t["c"]), (3, t["d"]), (4, t["c"]), (5, t["d"]), (None, t["a"]), (None, None)]
    got = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    want = [(1, t["a"]), (2, t["b"]), (3, t["c"]), (3, t["d"]), (None, t["a"]), (None, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


CLASHES = ("score", "_score", "digest", "_digest", "plan", "_plan", "again", "_again", "repeats", "fp", "source_size", "key", "root", "h")


def test_pipeline_stages_with_clashing_names_and_nulls(spark):
    """Columns of any name pass through the first four stages; nulls, empty texts and empty tables have their defined results."""
    rows = [(k, f"clean words number {k} of this small text", "src") for k in range(30)] + [(None, None, None), (40, None, "src"), (41, "", None), (42, "long " * 50_000, "src"), (43, "same text", "a"), (43, "same text", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    d = d.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, d, FOLDER)
        assert got.columns == d.columns, name
        for r in got.collect():
            assert all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
        assert stage(spark, d.limit(0), FOLDER).count() == 0, name
    dedup = sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[1][1](spark, d, FOLDER).collect())
    assert dedup == sorted([*map(str, range(30)), "None", "40", "42", "43"])  # empty texts are one group, its row without id stays
    clean = corpus_pipeline.STAGES[2][1](spark, d, FOLDER).collect()
    assert len(clean) == len(rows)
    taken = {}
    for r in corpus_pipeline.STAGES[3][1](spark, d, FOLDER).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + 1
    assert max(taken.values()) <= 4 and (None, None) not in taken  # a source without words gets nothing; two equal rows, twice each


def test_write_leaves_no_scratch_behind(spark):
    """What near-dedup writes on its way is deleted when its groups stand."""
    import glob

    from pagelore.session import shared_dir

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = f"{shared_dir(spark)}/pagelore/{spark.sparkContext.applicationId}/*"
    before = set(glob.glob(tables))
    shingle_overlap.keep_first(d).count()
    assert not [p for p in set(glob.glob(tables)) - before if any(w in p for w in ("/prefixes-", "/cells-", "/pairs-", "/sets-", "/wanted-", "/verified-", "/labels-", "/links-"))]
