"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule is (name, measure, comparison, bound). A row is judged on its own, so nothing is shuffled, and no user
function runs. Repeated word windows are found by sorting a row's windows next to each other, which stays
n log n for the longest text.

Cases: a null or empty text has no words, all counts are zero and the base rule fails; ties and repeated rows are
judged one by one; an empty table gives no rows; columns of the input that carry the names used here are not
touched, since only the id and the text are read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "it", "is", "for", "was", "on", "are", "this", "by", "from", "at", "or",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "für", "nicht", "sich", "auf", "ein", "eine", "als", "dem", "zu",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "par", "pour", "sur", "pas", "avec", "au",
    "el", "los", "las", "del", "y", "que", "en", "por", "con", "para", "una", "su", "al", "lo", "como", "se", "no",
)

# (rule, measure, comparison that must hold, bound)
THRESHOLDS = (
    ("words_least", "n_words", ">=", 50),
    ("words_most", "n_words", "<=", 1_000_000),
    ("word_length_least", "word_length", ">=", 2.0),
    ("word_length_most", "word_length", "<=", 15.0),
    ("symbols_per_word", "symbols_per_word", "<=", 0.25),
    ("stop_words", "n_stop_words", ">=", 2),
    ("duplicate_lines", "duplicate_line_share", "<=", 0.5),
    ("bullet_lines", "bullet_line_share", "<=", 0.9),
    ("ellipsis_lines", "ellipsis_line_share", "<=", 0.5),
    ("repeated_windows", "repeat_share", "<=", 0.5),
)
_COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found at least twice in the row."""
    n = F.size(words) - 2
    at = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    windows = F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"), at.alias("at"))
    return F.when(n >= 2, F.sort_array(windows))


def _neighbours(sorted_windows: Column) -> Column:
    """Windows that equal the next one in sorted order, as pairs (x, y)."""
    m = F.size(sorted_windows) - 1
    beside = F.arrays_zip(F.slice(sorted_windows, F.lit(1), m).alias("x"), F.slice(sorted_windows, F.lit(2), m).alias("y"))
    return F.filter(beside, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))


def _starts(equal: Column) -> Column:
    """Places of the windows in such pairs, ascending."""
    return F.sort_array(F.array_distinct(F.concat(F.transform(equal, lambda p: p["x"]["at"]), F.transform(equal, lambda p: p["y"]["at"]))))


def _union_length(starts: Column) -> Column:
    """Length of the union of [s, s + 3) over ascending starts."""
    pairs = F.arrays_zip(starts.alias("s"), F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))).alias("t"))
    return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + F.least(F.lit(3), F.coalesce(p["t"] - p["s"], F.lit(3))))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts and the ratios that rules may name."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.array_remove(F.split("t", BLANK + "+"), "").alias("words"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), repeated_words(F.col("words")).alias("windows"),
        F.length(F.regexp_replace("t", BLANK + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipses"))
    d = d.withColumn("equal", _neighbours(F.col("windows"))).drop("windows")
    d = d.withColumn("starts", _starts(F.col("equal"))).drop("equal")
    d = d.withColumn("n_repeat_words", F.coalesce(_union_length(F.col("starts")), F.lit(0)).cast("long")).drop("starts")

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return d.withColumns({
        "word_length": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"), "bullet_line_share": share("n_bullets", "n_lines"),
        "ellipsis_line_share": share("n_ellipses", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def compile_rules(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that fail), as columns over `measures`."""
    tests = [(name, _COMPARE[sign](F.col(measure), F.lit(bound))) for name, measure, sign, bound in thresholds]
    holds = reduce(operator.and_, (t for _, t in tests), F.lit(True))
    failed = F.filter(F.array(*(F.when(~t, F.lit(name)) for name, t in tests)), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    return holds, failed


def judge(docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, base_failed, kept and failed_rules of every document."""
    holds, failed = compile_rules(thresholds)
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), (~base & holds).alias("kept"), failed.alias("failed_rules"))


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS covered
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / n_words >= 2 AND word_chars / n_words <= 15 AND n_symbols / n_words <= 0.25
       AND n_stop >= 2 AND n_dup_lines / n_lines <= 0.5 AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""
