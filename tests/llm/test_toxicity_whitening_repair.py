"""Toxicity, whitening and conversation repair against plain versions."""

import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.llm import conversations, toxicity, whitening

FOLDER = "/root/testdata/sf0.001"
ROLES = {"u": "user:", "a": "assistant:"}
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_audit(rows):
    """Cheapest, then ASCII-least audit by a search over whole audits."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role in NEXT[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, NEXT[state][role]))
                for t in "ua":
                    if t in NEXT[state]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, NEXT[state][t]))
        for t in "ua":
            if t in NEXT[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state][t]))


def plain_repair(rows):
    blanks, of = " \t\n\x0b\x0c\r", {}
    one = lambda v: " " if v is None else v
    for c, t, r, x in rows:
        of.setdefault(c, []).append((t, one(r), one(x)))
    out = {}
    for c, mine in of.items():
        left = []
        for t, r, x in sorted(mine, key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.sha256(z[2].encode()).hexdigest())):
            h = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
            x = "" if h == 1 else x.translate({ord(k): None for k in ".!?"}) if h == 2 else x
            left += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
        seen, faults = set(), []
        for _, r, x in left:
            s = x.strip(blanks)
            faults.append((r[:1], "blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else ""))
            seen.add((r, x))
        turns = {t for t, _, _ in left if t is not None}
        cost, audit = plain_audit(faults)
        text, i, last = [], 0, ""
        for letter in audit:
            other = "a" if last == "u" else "u"
            if letter == "I":
                text.append(ROLES[other])
                last = other
                continue
            _, r, x = left[i]
            i += 1
            if letter == "K":
                text.append(f"{r}:{x}")
                last = r[:1]
            elif letter == "R":
                text.append(ROLES[other] + x)
                last = other
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f == k for _, f in faults) for k in ("blank", "duplicate", "truncated")],
                  sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def _conversations(seed=1, n=1200):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]),
             rng.choice(["Hi.", "Hi", "  ", "", "Ok!\n", "Yes? ", "A.B", "x", "é", None, "long " * 5000 + "."])) for _ in range(n)]
    rows += [(1000, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(300)] + [(1001, 5, "user", "Again.")] * 200
    return rows + [(1002, None, None, None), (1003, next(t for t in range(99) if zlib.crc32(f"1003:{t}".encode()) % 20 == 0), "user", "gone")]


def test_repair(spark, monkeypatch):
    """Every cell equal to the plain search, pieces cut anywhere; nulls, repeats, one turn, other roles, no rows left."""
    monkeypatch.setattr(conversations, "PIECE", 7)
    rows = _conversations()
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(d).collect()}
    want = plain_repair(rows)
    assert got == want
    assert got[1003] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(d.limit(0)).count() == 0


def test_repair_sql(spark):
    rows = _conversations(3, 600)
    import pandas as pd

    db = duckdb.connect()
    db.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    db.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    assert {r[0]: r[1:] for r in db.execute(conversations.SQL).fetchall()} == plain_repair(rows)


def test_automaton_makes_a_node_once(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("AEIMCGBD") for _ in range(rng.randrange(7))) for _ in range(300)]
    d = spark.createDataFrame([(s,) for s in some], "signature string")
    got = {r.signature: r for r in conversations.plans(d.coalesce(1)).collect()}
    for s, r in got.items():
        assert (r.cost, r.audit) == plain_audit([conversations._role_fault(x) for x in s])
    suffixes = {s[k:] for s in some for k in range(len(s))}
    made = sum(r.new_nodes for r in got.values())
    assert len(suffixes) <= made <= len(suffixes) + 8 * 7  # each task begins with an empty path
    alone = conversations.Automaton()
    for s in sorted(x[::-1] for x in set(some)):
        alone.path(s)
    assert alone.made == len(suffixes)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).round(3)
    rows = [(k, v[k % 600].tolist()) for k in range(700)] + [(None, v[3].tolist()), (605, v[4].tolist())] + [(1000 + k, v[0].tolist()) for k in range(300)]
    bad = [(2000, None), (2001, [None, *v[1][1:].tolist()]), (2002, [float("nan"), *v[1][1:].tolist()]), (2003, [float("inf"), *v[1][1:].tolist()]), (2004, []), (2005, [1.0] * 11),
           (2006, [1e300, *v[1][1:].tolist()])]
    d = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<double>, component int").repartition(7)
    got = whitening.whiten(d, most=5, block_rows=64).collect()
    x = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - total / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 6))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for k in (0, 5, 650, 1001):
        at = [i for i, row in enumerate(rows) if row[0] == k][0]
        mine = sorted(by[k], key=lambda r: r.component)
        assert {r.deviation for r in mine} == {int(((n * x[at] - total) ** 2).sum())}
        assert np.allclose(np.abs([r.whitened for r in mine]), np.abs((x[at] - total / n) @ w[:, :5] / np.sqrt(e[:5])), atol=1e-9)
        assert np.allclose([r.explained for r in mine], e[:5] / e.sum(), rtol=1e-9)
    assert len(by[605]) == 10 and len(by[None]) == 5
    z = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in range(600)])
    assert np.abs(z.T @ z / len(z) - np.eye(5)).max() < 1e-6 and {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained) for r in got} == {(1, 0, None, 0.0)}
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.whitened is None) for r in got} == {(1, 1, False), (2, 1, False), (1, 2, True), (2, 2, True)}
    got = whitening.whiten(spark.createDataFrame([(1, [2.0 ** 40]), (2, [-(2.0 ** 40)]), (3, [0.0])], schema)).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 0}


def test_nearest_examples_are_exact():
    """The index finds what all cosines find, ties by order, and reads part of the blocks."""
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 6, 60)
    entries = {}
    for _ in range(3000):
        size = int(rng.integers(0, 6))
        terms = tuple(sorted(rng.choice(60, size, replace=False).tolist()))
        tf = tuple(rng.integers(1, 4, size).tolist())
        entries[terms, tf] = (terms, tf, int(rng.integers(1, 4)), 0, len(entries))
    index = toxicity.Index.build(idf, list(entries.values()))
    order = sorted(entries.values())
    dense = np.zeros((len(order), 60))
    for k, e in enumerate(order):
        if e[0]:
            dense[k, list(e[0])] = (1 + np.log(e[1])) * idf[list(e[0])]
            dense[k] /= np.linalg.norm(dense[k])
    for _ in range(150):
        terms = np.sort(rng.choice(60, int(rng.integers(1, 8)), replace=False))
        tf = rng.integers(1, 4, len(terms)).astype(float)
        q = np.zeros(60)
        q[terms] = index.weights(terms, tf)
        sims = np.round(dense @ q, 12)
        want = np.lexsort((np.arange(len(sims)), -sims))[:15]
        got, s = index.nearest(terms, tf, 15)
        assert np.allclose(s, sims[want]) and got.tolist() == want.tolist()
    assert index.nearest(np.zeros(0, np.int64), np.zeros(0), 15)[0].tolist() == [0]


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        words = [word() for _ in range(rng.randrange(5, 60))]
        if toxic:
            words += [rng.choice(["scumbag", "IDIOT,", "morons."]) for _ in range(rng.randrange(1, 4))]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    odd = [(None, "idiot"), (9000, None), (9001, ""), (9002, "word " * 200_000 + "idiot scumbag"), (9003, "idiot"), (9003, "fine words")]
    d = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, score string").repartition(6)
    lab = spark.createDataFrame([*labels, (None, 1), (9000, None), (0, 1)], "doc_id long, toxic int")
    got = toxicity.judge(d, lab).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(1500) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.99 * len(held)
    by = {r.doc_id: r for r in got if r.doc_id in (9000, 9001, 9002)}
    assert by[9000].predicted == 0 == by[9001].predicted and by[9002].predicted == 1 and by[9002].evidence[0].toxic == 1.0
    assert not next(r for r in got if r.doc_id is None).held_out
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((str(r.doc_id), r.score) for r in toxicity.judge(d, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert {r.score for r in toxicity.judge(d, lab.limit(0)).collect()} == {0.5}
    assert toxicity.judge(d.limit(0), lab).count() == 0


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_of_one_kind(spark, toxic):
    d = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    scores = {r.score for r in toxicity.judge(d, spark.createDataFrame([(k, toxic) for k in range(40)], "doc_id long, toxic int")).collect()}
    assert len(scores) == 1 and abs(scores.pop() - toxic) < 0.5
