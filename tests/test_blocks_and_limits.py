"""Block clusters against a plain version; limits that are off by default."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pagelore.functions import checks as C
from pagelore.operators import provenance as V
from pagelore.operators.aggregates import key_findings
from pagelore.operators.clusters import page_clusters
from pagelore.operators.sets import budget_prefix


def plain_clusters(blocks, t=0.8, least=10, k=3):
    """One page: dict block -> (text, words)."""
    vec, n = {}, 0
    counts = {b: Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]) for b, w in ((b, x.lower().split()) for b, (x, _) in blocks.items()) if w}
    distinct = {}
    for b in sorted(counts):
        distinct.setdefault(" ".join(blocks[b][0].lower().split()), b)
    df = Counter(w for b in distinct.values() for w in counts[b])
    n = len(distinct)
    for b in distinct.values():
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in counts[b].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[b] = {w: x / norm for w, x in v.items()}
    parent = {b: b for b in blocks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in counts:
        parent[b] = distinct[" ".join(blocks[b][0].lower().split())]
    ids = sorted(vec)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if round(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()), 9) >= t:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for b in blocks:
        g = groups.setdefault(find(b), [0, 0])
        g[0] += 1
        g[1] += blocks[b][1]
    best = sorted(((-w, c, n) for c, (n, w) in groups.items() if w >= least))[:k]
    return [(c, n, -w, i + 1) for i, (w, c, n) in enumerate(best)]


def test_page_clusters(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for page in range(40):
        base = [[rng.choice(words) for _ in range(12)] for _ in range(3)]
        for block in range(rng.randrange(25)):
            w = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(15))]
            if rng.random() < 0.4 and w:
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((page, block, " ".join(w), len(w)))
    rows += [(99, k, "the same text again and again in here", 8) for k in range(400)]
    d = spark.createDataFrame(rows, "page_id long, block int, text string, words int")
    got = {}
    for r in page_clusters(d).collect():
        got.setdefault(r.page_id, []).append((r.cluster, r.n_blocks, r.words, r.rank))
    by = {}
    for page, block, text, n in rows:
        by.setdefault(page, {})[block] = (text, n)
    assert {p: sorted(x, key=lambda r: r[3]) for p, x in got.items()} == {p: c for p, b in by.items() if (c := plain_clusters(b))}
    asked = page_clusters(d, query="the same text again and again in here", min_words=1).collect()
    assert {r.page_id for r in asked} == {99} and asked[0].n_blocks == 400
    assert page_clusters(d.limit(0)).count() == 0


def test_limits_are_off_by_default(spark):
    text = "a" * 100_000
    d = spark.createDataFrame([(text, "\n".join(f"- finding number {k} of many lines" for k in range(50)))], "t string, f string")
    r = d.select(F.length(C.sanitize_input(F.col("t"))).alias("whole"), F.length(C.sanitize_input(F.col("t"), 1000)).alias("cut"), F.size(key_findings(F.col("f"))).alias("all"),
                 F.size(key_findings(F.col("f"), 10)).alias("ten"), F.length(C.shrink_payload({"t": F.col("t")}, {"t": "text"})).alias("payload"),
                 F.length(C.shrink_payload({"t": F.col("t")}, {"t": "text"}, max_bytes=10)).alias("small")).first()
    assert (r.whole, r.cut, r["all"], r.ten) == (100_000, 1000, 50, 10) and r.payload > 100_000 > 2000 > r.small
    claims = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "one two three four five six " + "more " * 200) for k in range(9)], "doc_id long, text string")
    e = V.claim_evidence(claims, docs, "item_id", "doc_id")
    v = V.verdicts(e, docs, claims, "item_id", "doc_id").first()
    assert v.n_for == 9 and len(v.evidence) == 9 and len(v.evidence[0].snippet) > 1000
    few = V.verdicts(e, docs, claims, "item_id", "doc_id", k=5, chars=300).first()
    assert few.n_for == 5 and len(few.evidence) == 5 and len(few.evidence[0].snippet) == 300


def test_budget_charges_nothing_for_empty_lines(spark):
    d = spark.createDataFrame([("a", k, c) for k, c in enumerate([3, 0, 2, 0, 0, 1, 0, 5, 0])], "g string, i int, c int")
    got = sorted(r.i for r in budget_prefix(d, ["g"], [F.col("i")], F.col("c"), 6).collect())
    assert got == [0, 1, 2, 3, 4, 5, 6]
