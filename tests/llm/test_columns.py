"""Operators that work in the row or by plain aggregates: quality rules, personal data, mixing, addresses, archive."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import check
from pagelore.llm import catalogue, mixing, pii, quality_rules, url_templates, warc_archive
from pagelore.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, words string, t string, found string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, source, "clash", "clash", "clash") for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_sql(spark, name):
    ok, got, want = check.compare(spark, check.connect(FOLDER), name, catalogue.queries()[name], catalogue.oracle_sql()[name], FOLDER)
    assert ok and got[1], (got[0], want[0])


TEXTS = [None, "", "   \n\t", "one", "a b", "a b c a b c", "x " * 300, "a b c d " * 40, "line\nline\n\n \nline\nother", "# $ % & | < > * né à",
         "the cat and the dog " + " ".join(f"word{k}" for k in range(200)), "a\x0bb\x0cc\u00a0d e\u2028f", "\U0001f600 " * 60, "- a\n- b\n* c", "dots...\ndots…\nend"]


def plain_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, x in enumerate(windows) if x in twice for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, TEXTS)).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        want = plain_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, t
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or r.failed_rules)
    assert got[10].kept and got[10].n_stop_words == 3
    assert quality_rules.judge(docs(spark, ["a"]).limit(0)).count() == 0


def test_quality_rules_plan(spark):
    plan = quality_rules.judge(docs(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_own_thresholds(spark):
    got = quality_rules.judge(docs(spark, ["w " * 10 + " ".join(f"q{k}" for k in range(60))]), thresholds=(("few", "n_words", "<", 20),)).first()
    assert got.failed_rules == ["few"] and not got.kept


PERSONAL = [
    None, "", "mail a.b@c-d.example.com, a@b or x@y.z@w.v", "a@b.c_x@d.e %%@q.r.s.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111, 4111111111111112",
    "é\U0001f600 4111-1111-1111-1111 +1 (555) 010-9999. +49 30 1234567 +1 2", "+" * 50 + "1" + "(" * 300, "1" * 5000, "x" * 20000 + "@" + "y" * 20000, "1 " * 4000,
    "call me: (555) 123-4567 or 555-123-4567; " * 3, "write to joe (at) example (dot) com now", "+12345678901 " * 600]


def plain_spans(text):
    out = []
    text = text or ""
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in pats.items():
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), list(pats).index(kind), m.end()))
    return sorted(out)


def test_personal_data(spark):
    texts = [t for t in PERSONAL if not (t and t.startswith("xxx"))]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = plain_spans(t)
        joined = ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in want)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(i == j for _, i, _ in want) for j in range(4)], t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")), t
    long = pii.personal_data(docs(spark, [PERSONAL[9]])).first()  # no way back into the run of characters
    assert long.n_email == 0
    assert pii.personal_data(docs(spark, ["a"]).limit(0)).count() == 0


def test_reliabilities():
    counts = {(0, 0, 1, 1, 1, 0, 0, 0): 80, (0, 0, -1, -1, -1, 0, 0, 0): 90, (0, 0, 1, 1, -1, 0, 0, 0): 10, (0, 0, -1, 1, -1, -1, 0, 0): 10}
    chance, posterior = pii.reliabilities(counts)
    assert posterior[(0, 0, 1, 1, 1, 0, 0, 0)] > 0.9 and posterior[(0, 0, -1, -1, -1, 0, 0, 0)] < 0.1
    assert chance[(0, 0)][1][1] > 0.8 and chance[(0, 0)][0][-1] > 0.8
    w = pii.classifier(counts, posterior)
    assert w[(0, 0, 1)] > w[(0, 0, -1)]


def test_mixing(spark):
    rows = [(k, "w " * (k % 7 + 1), ["a", "b", "c", None][k % 4 if k % 3 else 0]) for k in range(4000)] + [(None, None, "a"), (9, "", None), (9, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("repeats", F.lit("clash"))
    got = mixing.mix_report(d).collect()
    again = sorted(map(str, mixing.mix_report(d.repartition(5)).collect()))
    assert again == sorted(map(str, got)) and len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    free = {s for s in sizes if target[s] < 2 * sizes[s] - 1e-9}
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1 and len(free) < 4
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 4
        assert s in free or abs(target[s] - 2 * sizes[s]) < 1e-9
    out = mixing.mixed(d)
    assert out.columns == d.columns
    assert out.count() == sum(r.repeats for r in got)
    assert mixing.mix_report(d.limit(0)).count() == 0


def test_rules_for_addresses(spark):
    cases = [("http://A.B.Net/x", "a.b.net", "/x", "net/", "block"), ("http://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
             ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
             ("http://x.org/fr/?a=://b.net/", "x.org", "/fr/", "org/fr/", "allow"), ("http://x.org/fr", "x.org", "/fr", None, "allow"), ("http://badnet/x", "badnet", "/x", None, "allow"),
             ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://net", "net", "", None, "allow"), ("ftp://?q", "", "", None, "allow")]
    d = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(cases)], "page_id long, url string, template string")
    none = spark.createDataFrame([], "url string, label int")
    got = {r.page_id: r for r in url_templates.judge(d, none).collect()}
    for k, c in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == c[1:], c
    assert url_templates.judge(d.limit(0), none).count() == 0


def test_template_tree(spark):
    urls = [f"http://h.com/spam/{k}/x{k}" for k in range(200)] + [f"http://h.com/good/{k}" for k in range(200)] + [f"http://h.com/fine/{k}" for k in range(200)] + [f"http://h.com/{k}" for k in range(50)]
    d = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(9999, urls[0])], "page_id long, url string")
    labels = spark.createDataFrame([(u, int("spam" in u)) for u in urls[::2]], "url string, label int")
    got = url_templates.judge(d, labels).collect()
    assert {r.template for r in got} == {"/spam/{n}/{id}", "/{fine+1}/{n}", "/{n}"}
    assert {r.verdict for r in got if "/spam/" in r.path} == {"block"} and {r.verdict for r in got if "/spam/" not in r.path} == {"allow"}
    assert len(got) == len(urls) + 1


def test_archive(spark):
    rows = [(k, f"http://h/{k}", f"body {k % 5} é") for k in range(40)] + [(50, None, None), (51, "u", ""), (None, "n", "body 1 é"), (None, "n", "alone"), (7, "again", "body 2 é")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    to = scratch_path(spark, "archive")
    warc_archive.write_archive(d, to)
    got = warc_archive.read_index(spark, to).collect()
    assert len(got) == len(rows) and spark.read.parquet(f"{to}/payloads").count() == 7
    for r in got:
        assert r.payload_digest == r.header_digest and len(r.payload_digest) == 32
        if r.page_id is not None and r.page_id < 40:
            last = 35 + r.page_id % 5
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))
    empty = [r for r in got if r.page_id in (50, 51)]
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in empty} == {(50, "revisit", 51, 0), (51, "response", None, 0)}
    # the records are WARC: cut again from their bytes, payloads and headers come back
    whole = warc_archive.records(spark, to)
    one = whole.agg(F.array_join(F.collect_list(F.decode("record", "UTF-8")), "").cast("binary").alias("content"))
    cut = warc_archive.split_records(one).collect()
    assert len(cut) == len(rows)
    assert {bytes(c.payload).decode() for c in cut if c.http} == {r[2] or "" for r in rows}
    assert Counter(bytes(c.header) for c in cut) == Counter(bytes(r.header) for r in spark.read.parquet(f"{to}/headers").collect())
    to = scratch_path(spark, "archive")
    warc_archive.write_archive(d, to, min_bytes=1000)
    assert {r.record_type for r in warc_archive.read_index(spark, to).collect()} == {"response"}
    to = scratch_path(spark, "archive")
    warc_archive.write_archive(d.limit(0), to)
    assert warc_archive.read_index(spark, to).count() == 0
