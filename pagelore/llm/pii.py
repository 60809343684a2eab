"""Personal data by weak supervision, in DataFrame functions alone.

Base spans are the matches of four fixed patterns that pass their check. Besides these, wider patterns propose
candidates (numbers without a country code, addresses written out, long IP notation). Labelers vote on every candidate
for or against it, or abstain: the strict pattern, the layout, a gazetteer (top-level domains, calling codes, issuer
digits, address ranges) and the words in front. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability per kind without any labels; its posteriors train a span classifier, a logistic function of the
votes and the span's form. A wide candidate is added if the classifier gives it `accept` or more and it overlaps no base
span of its kind. Base spans always stay; a match of a base pattern that fails its check is never added.

Everything per document is column work in the document's row; the corpus statistics are one count per pattern of
votes and form, a table whose size is bounded by their number (PATTERNS), not by the data.

Patterns are written so that they cannot run away on long texts: repeats are possessive where nothing can be given back,
and a match may begin in a run of characters only at its start or where the last match ended, which finds the same
leftmost matches. Places come from prefix sums in blocks of 256 matches.

Cases: a null text counts as empty and gives no spans and the digest of the empty string; equal starts keep the order of
the kinds; repeated rows are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z]{2,24}|\.[A-Za-z]{2,24})",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[.][0-9]{4}[.][0-9]{4}[.][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|int|mil|info|biz|io|de|fr|es|uk|it|nl|eu|us|ca|au|ch|at|be|pl|se|jp|cn|in|br|mx|ru"
CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
FOR = {"email": "mail|contact|write to|address", "ip": r"\bip\b|host|server|address|client", "card": "card|visa|master|amex|credit|karte|tarjeta|carte",
       "phone": "tel|phone|call|fax|mobile|contact|telefon|móvil"}
AGAINST = {"email": "example:|format:", "ip": "version|release|v\\.|section", "card": "isbn|order|invoice|serial|token|hash", "phone": "isbn|order|invoice|id|serial|version"}
PATTERNS = len(KINDS) * 2 * 3 ** 4 * 4 * 3  # kind, base or wide, four votes, length, separators
_BLOCK = 256


def places(text: Column, pattern: str) -> Column:
    """array<struct<start,end,m>> of all matches, places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda p: F.struct(F.length(p["g"]).alias("g"), p["m"].alias("m")))
    steps = F.filter(steps, lambda p: p["m"].isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(_BLOCK))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

    def inside(block: Column) -> Column:
        return F.aggregate(F.slice(steps, block, F.lit(_BLOCK)), empty, lambda acc, p: F.struct(
            (acc["at"] + p["g"] + F.length(p["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("m")))).alias("out")))

    blocks = F.transform(starts, inside)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    before = F.aggregate(blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))["before"]
    moved = F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["m"].alias("m"))))
    return F.flatten(moved)


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the check sum."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for k in range(20):
        d = F.substring(padded, k + 1, 1).cast("int")
        total = total + (d if k % 2 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def strict(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, s: Column, base: bool) -> list[Column]:
    """Strict pattern, layout, gazetteer, context; 1 for, -1 against, 0 abstains."""
    m = s["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    ahead = F.lower(F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))))
    layout = {
        "email": (m.rlike(r"(?:\.|dot ?[)\]] ?)[A-Za-z]{2,24}$"), m.rlike(r"\.\.|^[.@-]")),
        "ip": (m.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$|:"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": (m.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), ~F.length(digits).between(14, 19)),
        "phone": (m.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}$"), m.rlike(r"[().-]{3}")),
    }[kind]
    listed = {
        "email": (m.rlike(rf"(?i)(?:\.|dot ?[)\]] ?)(?:{DOMAINS})$"), F.lit(False)),
        "ip": (m.rlike(r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-2][0-9])\.|:"), m.rlike(r"^(?:0|2[4-9][0-9])\.")),
        "card": (digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": (m.rlike(CALLING) | m.rlike(r"^\(?[2-9]"), m.rlike(r"^\(?[01]")),
    }[kind]
    first = F.when(strict(kind, m), 1).otherwise(-1) if base else F.lit(0)
    return [first, _vote(*layout), _vote(*listed), _vote(ahead.rlike(FOR[kind]), ahead.rlike(AGAINST[kind]))]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): all candidates of a document with kind number, place, whether the base pattern made it, and the
    pattern of votes and form by which it is judged."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    guard = {"email": F.contains("t", F.lit("@")), "phone": F.contains("t", F.lit("+")) & F.col("digit"), "ip": F.col("digit"), "card": F.col("digit")}
    wide = {"email": F.col("t").rlike(r"[(\[] ?at ?[)\]]"), "phone": F.col("digit"), "ip": F.contains("t", F.lit(":")), "card": F.col("digit")}
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    d = d.withColumn("digit", F.col("t").rlike("[0-9]"))
    d = d.select("doc_id", "t",
                 *(F.when(guard[k], places(F.col("t"), BASE[k])).otherwise(none).alias(f"b_{k}") for k in KINDS),
                 *(F.when(wide[k], places(F.col("t"), WIDE[k])).otherwise(none).alias(f"w_{k}") for k in KINDS))

    def judged(k: int, kind: str, base: bool) -> Column:
        def one(s: Column) -> Column:
            votes = _votes(kind, F.col("t"), s, base)
            size = s["end"] - s["start"]
            form = [F.when(size < 12, 0).when(size < 16, 1).when(size < 22, 2).otherwise(3), F.least(F.length(F.regexp_replace(s["m"], r"[^\x20()-]", "")), F.lit(2))]
            key = F.concat_ws("|", *(v.cast("string") for v in (F.lit(k), F.lit(int(base)), *votes, *form)))
            return F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), (votes[0] == 1).alias("ok"), key.alias("key"))

        return F.transform(F.col(("b_" if base else "w_") + kind), one)

    return d.select("doc_id", F.concat(*(judged(k, kind, base) for base in (True, False) for k, kind in enumerate(KINDS))).alias("found"))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50, prior: float = 5.0) -> tuple[dict, dict]:
    """Expectation-maximisation per kind over (kind, base, votes..., form...) -> number.

    Gives P(vote | personal or not) per (kind, labeler), and the posterior of every pattern. A conditionally
    independent model of the labelers; it starts from votes that are right three times in four.
    """
    chance: dict[tuple[int, int], dict] = {}
    posterior: dict[tuple[int, ...], float] = {}
    for kind in sorted({k[0] for k in counts}):
        mine = {k: n for k, n in counts.items() if k[0] == kind}
        p = {j: {1: {1: 0.6, 0: 0.2, -1: 0.2}, 0: {1: 0.2, 0: 0.2, -1: 0.6}} for j in range(4)}
        share = 0.5
        for _ in range(rounds):
            for k in mine:
                a = math.log(share) + sum(math.log(p[j][1][k[2 + j]]) for j in range(4))
                b = math.log(1 - share) + sum(math.log(p[j][0][k[2 + j]]) for j in range(4))
                posterior[k] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
            n1 = sum(n * posterior[k] for k, n in mine.items())
            n = sum(mine.values())
            share = min(0.99, max(0.01, (n1 + prior) / (n + 2 * prior)))
            for j in range(4):
                for y in (1, 0):
                    w = {v: prior * (0.6 if v == (1 if y else -1) else 0.2) for v in (1, 0, -1)}
                    for k, n_k in mine.items():
                        w[k[2 + j]] += n_k * (posterior[k] if y else 1 - posterior[k])
                    total = sum(w.values())
                    p[j][y] = {v: x / total for v, x in w.items()}
        chance |= {(kind, j): p[j] for j in range(4)}
    return chance, posterior


def classifier(counts: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Weights of a logistic span classifier by (kind, feature, value), trained on the posteriors as soft labels."""
    weights: dict[tuple[int, int, int], float] = {}

    def names(k):
        return [(k[0], -1, 0), *((k[0], j, v) for j, v in enumerate(k[2:]))]

    for k in counts:
        weights.update({f: 0.0 for f in names(k)})
    totals: dict[int, float] = {}
    for k, n in counts.items():
        totals[k[0]] = totals.get(k[0], 0) + n
    for _ in range(rounds):
        gradient = {f: decay * w for f, w in weights.items()}
        for k, n in counts.items():
            z = sum(weights[f] for f in names(k))
            g = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - posterior[k]) * n / totals[k[0]]
            for f in names(k):
                gradient[f] += g
        for f, g in gradient.items():
            weights[f] -= rate * g
    return weights


def score_patterns(found: DataFrame) -> dict[tuple[int, ...], float]:
    """Classifier score of every pattern that occurs, from the counts of all candidates."""
    rows = found.select(F.explode("found.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()  # at most PATTERNS rows
    counts = {tuple(map(int, key.split("|"))): n for key, n in rows}
    _, posterior = reliabilities(counts)
    weights = classifier(counts, posterior)
    return {k: 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(weights[f] for f in [(k[0], -1, 0), *((k[0], j, v) for j, v in enumerate(k[2:]))]))))) for k in counts}


def _joined(spans: Column) -> Column:
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda k: reduce(lambda other, i: F.when(k == i, KINDS[i]).otherwise(other), range(len(KINDS) - 1), F.lit(KINDS[-1]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    found = write_and_read(candidates(docs, id_col, text_col), "candidates")
    scores = score_patterns(found)
    taken = ["|".join(map(str, k)) for k, p in sorted(scores.items()) if not k[1] and p >= accept]
    base = F.filter("found", lambda s: s["base"] & s["ok"])
    d = found.select("doc_id", "found", base.alias("base"))
    if taken:
        more = F.filter("found", lambda s: ~s["base"] & s["key"].isin(*taken) & ~F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"])))
        d = d.select("doc_id", "base", F.concat("base", more).alias("all"))
    else:
        d = d.select("doc_id", "base", F.col("base").alias("all"))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return d.select("doc_id", *(number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
                    F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
