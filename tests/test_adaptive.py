"""Adaptive crawls against a plain sequential crawl, and restarts from the stored rounds."""

import random
import statistics

import pytest

from pagelore.operators.adaptive import StopRules, adaptive_crawl
from pagelore.session import scratch_path


def world(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(160)]
    pages = {f"p{k}": (sorted(set(rng.choices(vocabulary[:rng.choice([12, 60, 160])], k=rng.randrange(1, 30)))), round(rng.uniform(0.1, 1.0), 3)) for k in range(n)}
    for k in rng.sample(sorted(pages), 12):
        del pages[k]  # addresses that cannot be fetched
    links = {(f"p{rng.randrange(n)}", f"p{rng.randrange(n)}") for _ in range(700)}
    score = {f"p{k}": round(rng.uniform(0.1, 1.0), 2) for k in range(n)}
    seeds = [(f"c{k}", f"p{rng.randrange(n)}", rng.sample(vocabulary, 6) if k % 4 else []) for k in range(14)]
    return pages, links, score, seeds


def sequential(pages, links, score, seed, query, rules, least=0.3):
    out, terms, fresh, quality, relevance = [], set(), [], [], []
    known, tried, number, confidence, tries = {seed: (1.0, 0)}, set(), 0, 0.0, 0
    while True:
        open_ = sorted((-s, found, u) for u, (s, found) in known.items() if u not in tried)
        if not open_:
            return out
        number += 1
        s, _, url = open_[0]
        tried.add(url)
        tries += 1
        got = pages.get(url)
        new = None
        if got:
            mine = set(got[0])
            new = len(mine - terms)
            terms |= mine
            fresh.append(new)
            quality.append(got[1])
            if query:
                relevance.append(len(mine & set(query)) / len(mine | set(query)))
            gain = 1 - statistics.fmean(fresh[-3:]) / rules.expected_terms if len(fresh) > 1 else 0.0
            steady = [max(0.0, 1 - statistics.pstdev(m[-5:])) if len(m) > 1 else 0.0 for m in (quality, relevance)]
            confidence = round(0.4 * gain + 0.3 * steady[0] + 0.3 * steady[1], 12)
        n = len(fresh)
        reason = None
        if rules.max_pages is not None and n >= rules.max_pages:
            reason = "pages"
        elif rules.saturation_terms is not None and n >= rules.saturation_pages and statistics.fmean(fresh[-rules.saturation_pages:]) < rules.saturation_terms:
            reason = "saturation"
        elif rules.confidence is not None and confidence >= rules.confidence:
            reason = "confidence"
        elif rules.quality is not None and n >= 3 and statistics.fmean(quality[-3:]) < rules.quality:
            reason = "quality"
        elif rules.max_tries is not None and tries >= rules.max_tries:
            reason = "tries"
        out.append((number, url, -s, bool(got), new or 0, round(confidence, 9), reason))
        if reason:
            return out
        for a, b in links:
            if a == url and score[b] >= least:
                known.setdefault(b, (score[b], number))


def frames(spark, pages, links, score, seeds):
    p = spark.createDataFrame([(u, t, q) for u, (t, q) in pages.items()] + [(None, ["x"], 1.0), ("p0", ["zz"], 0.0)][:1], "node string, terms array<string>, quality double")
    e = spark.createDataFrame([(a, b, score[b]) for a, b in links] + [(None, "p1", 1.0), ("p1", None, 1.0)], "src string, dst string, score double")
    s = spark.createDataFrame([*seeds, (None, "p1", []), ("c99", None, [])], "crawl string, node string, query array<string>")
    return p, e, s


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.crawl, r["round"], r.pos)):
        out.setdefault(r.crawl, []).append((r["round"], r.node, r.score, r.fetched, r.new_terms, round(r.confidence, 9), r.reason))
    return out


@pytest.mark.parametrize("rules", [StopRules(max_pages=9, confidence=0.93), StopRules(max_pages=None, confidence=None, quality=None, saturation_terms=9.0, max_tries=8)])
def test_equal_to_a_sequential_crawl(spark, rules):
    pages, links, score, seeds = world()
    got = rows(adaptive_crawl(*frames(spark, pages, links, score, seeds), rules))
    assert got == {c: sequential(pages, links, score, s, q, rules) for c, s, q in seeds}
    assert len({r[-1][-1] for r in got.values()}) >= 2


def test_restart_gives_the_same_rows(spark):
    pages, links, score, seeds = world(3)
    f, rules = frames(spark, pages, links, score, seeds[:4]), StopRules(max_pages=5, confidence=None, quality=None)
    folder = scratch_path(spark, "restart")
    first = adaptive_crawl(*f, rules, folder=folder, max_rounds=2)
    assert max(r["round"] for r in first.collect()) == 2
    assert rows(adaptive_crawl(*f, rules, folder=folder)) == {c: sequential(pages, links, score, s, q, rules) for c, s, q in seeds[:4]}


def test_batches_stop_at_the_same_page_count(spark):
    pages, links, score, seeds = world(5)
    rules = StopRules(max_pages=6, confidence=None, quality=None, saturation_terms=None)
    got = rows(adaptive_crawl(*frames(spark, pages, links, score, seeds), rules, batch=4))
    for c, s, q in seeds:
        assert sum(r[3] for r in got[c]) == sum(r[3] for r in sequential(pages, links, score, s, q, rules))
    assert adaptive_crawl(*(x.limit(0) for x in frames(spark, pages, links, score, seeds))).count() == 0
