"""Chunking of the documents by every strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as C
from .registry import Inputs, query

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def rows(t: Inputs, col, docs=None):
    return (t.spread("documents") if docs is None else docs).select("doc_id", F.posexplode(col).alias("idx", "chunk")).select("doc_id", "idx", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("chunk_md5"))


def out_sql(cte: str) -> str:
    return f"{cte} SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS idx, length(unnest(c)) AS n, md5(unnest(c)) AS chunk_md5 FROM x"


@query("chk_01_regex", out_sql(f"""
WITH s0 AS (SELECT doc_id, [text] AS c FROM documents),
s1 AS (SELECT doc_id, flatten(list_transform(c, lambda p: CASE WHEN length(p) > 300 THEN list_filter(list_transform(string_split(p, chr(10) || chr(10)), lambda y: {STRIP.format('y')}), lambda y: y <> '') ELSE [p] END)) AS c FROM s0),
s2 AS (SELECT doc_id, flatten(list_transform(c, lambda p: CASE WHEN length(p) > 300 THEN list_filter(list_transform(string_split(p, chr(10)), lambda y: {STRIP.format('y')}), lambda y: y <> '') ELSE [p] END)) AS c FROM s1),
s3 AS (SELECT doc_id, flatten(list_transform(c, lambda p: CASE WHEN length(p) > 300 THEN list_filter(list_transform(string_split(p, '. '), lambda y: {STRIP.format('y')}), lambda y: y <> '') ELSE [p] END)) AS c FROM s2),
x AS (SELECT doc_id, list_filter(c, lambda p: length({STRIP.format('p')}) >= 10) AS c FROM s3)"""))
def regex(t: Inputs):
    return rows(t, C.regex_chunks(F.col("text"), max_length=300))


@query("chk_02_sentences")
def sentences(t: Inputs):
    return rows(t, C.sentence_chunks(F.col("text")))


@query("chk_03_paragraphs")
def paragraphs(t: Inputs):
    return rows(t, C.paragraph_chunks(F.col("text")))


@query("chk_04_fixed", out_sql(f"""
WITH x AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text] ELSE list_filter(list_transform(range(0, length(text), 900), lambda i: {STRIP.format('substr(text, i + 1, 1000)')}), lambda y: y <> '') END AS c FROM documents)"""))
def fixed(t: Inputs):
    return rows(t, C.fixed_chunks(F.col("text")))


@query("chk_04_words")
def word_cuts(t: Inputs):
    return rows(t, C.word_chunks()(F.col("text")))


@query("chk_05_topics")
def topics(t: Inputs):
    # much work per text: pieces of bounded size, however large the table
    return rows(t, C.topic_chunks(F.col("text")), t.by_id("documents", piece=2 << 20))


@query("chk_06_hybrid")
def hybrid(t: Inputs):
    return rows(t, C.hybrid_chunks(F.col("text")))


@query("chk_07_tokens", out_sql(f"""
WITH x AS (SELECT doc_id, CASE WHEN length(text) <= 400 THEN [text] ELSE list_filter(list_transform(range(0, length(text), 360), lambda i: {STRIP.format('substr(text, i + 1, 400)')}), lambda y: y <> '') END AS c FROM documents)"""))
def tokens(t: Inputs):
    return rows(t, C.token_chunks(F.col("text"), 100, 10))


@query("chk_07_dispatch", """
SELECT doc_id, 'identity' AS strategy, 1::BIGINT AS n FROM documents UNION ALL
SELECT doc_id, 'fixed', CASE WHEN length(text) <= 1000 THEN 1 ELSE len(list_filter(list_transform(range(0, length(text), 900), lambda i: regexp_replace(substr(text, i + 1, 1000), '^\\s+|\\s+$', '', 'g')), lambda y: y <> '')) END FROM documents""")
def dispatch(t: Inputs):
    """Strategies by name through the registry."""
    from ..functions.strategies import CHUNKERS
    d = [t.spread("documents").select("doc_id", F.lit(s).alias("strategy"), F.size(CHUNKERS[s](F.col("text"))).cast("long").alias("n")) for s in ("identity", "fixed")]
    return d[0].unionByName(d[1])
