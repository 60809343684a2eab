"""Vector search over the embeddings table and over encoded documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encoders import hashing_encoder
from ..operators import vectors as V
from ..operators.skew import top_per_key
from .registry import Inputs, query
from .retrieval import BM25_SQL, ranked

CENT = "cent AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(e) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
SCORE = "round((list_cosine_similarity(q, embedding::DOUBLE[]) + 1) / 2, 6)"


def corpus(t: Inputs):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def centroids(t: Inputs):
    """One query vector per namespace: its mean."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg("e").alias("m"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("embedding")).withColumnRenamed("label", "query_id")


def top_sql(where: str = "TRUE") -> str:
    return f"""WITH {CENT}, s AS (SELECT query_id::BIGINT AS query_id, vec_id AS id, {SCORE} AS score FROM cent, embeddings WHERE {where})
SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 10"""


@query("vec_01_search", top_sql())
def search(t: Inputs):
    return V.search(corpus(t), centroids(t), 10, 0.5)


@query("vec_02_filtered", top_sql("label IN (1, 4, 7)"))
def filtered(t: Inputs):
    return V.search(corpus(t).where(F.col("label").isin(1, 4, 7)), centroids(t), 10, 0.5)


@query("vec_03_similar_items", """
WITH m AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY 1), q AS (SELECT query_id, embedding::DOUBLE[] AS q FROM m JOIN embeddings ON vec_id = query_id),
s AS (SELECT query_id, vec_id AS id, round((list_cosine_similarity(q, embedding::DOUBLE[]) + 1) / 2, 6) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def similar_items(t: Inputs):
    """Neighbours of the first item of each namespace, the item itself left out."""
    q = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("query_id")).select("query_id", "embedding")
    return V.search(corpus(t), q, 5, exclude_self=True)


def _encode_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)) AS raw FROM (SELECT {key}, map_from_entries(list((slot, v))) AS m FROM (
  SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v
  FROM (SELECT {key}, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM {table}) GROUP BY 1, 2) GROUP BY 1)"""


@query("vec_04_neural_rerank", f"""
WITH {BM25_SQL}, qv AS ({_encode_sql('benchmark', 'item_id')}), dv AS ({_encode_sql('documents', 'doc_id')}),
u AS (SELECT item_id, doc_id, round(list_cosine_similarity(qv.raw::DOUBLE[], dv.raw::DOUBLE[]), 5) AS similarity FROM hits JOIN qv USING (item_id) JOIN dv USING (doc_id) WHERE hits.rank <= 20)
SELECT item_id, doc_id, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM u) WHERE rank <= 10""")
def neural_rerank(t: Inputs):
    """BM25 candidates, twice the wanted number, reordered by cosine of encoded texts."""
    q = t.benchmark.select("item_id", hashing_encoder(F.col("text")).alias("qv"))
    d = t.spread("documents").select("doc_id", hashing_encoder(F.col("text")).alias("dv"))
    h = ranked(t, 20).drop("rank").join(q, "item_id").join(d, "doc_id").withColumn("similarity", F.round(V.cosine(F.col("qv"), F.col("dv")), 5))
    return top_per_key(h.select("item_id", "doc_id", "similarity"), ["item_id"], [F.col("similarity").desc(), F.col("doc_id")], 10)


@query("vec_05_embedding_cache", """
WITH d AS (SELECT doc_id, md5(text) AS content_md5, lang FROM documents), c AS (SELECT DISTINCT content_md5 FROM d WHERE lang = 'en')
SELECT doc_id, content_md5, content_md5 IN (SELECT content_md5 FROM c) AS cached, 64 AS dims FROM d""")
def embedding_cache(t: Inputs):
    cache = t.spread("documents").where("lang = 'en'").select(F.md5("text").alias("content_md5"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding")).dropDuplicates(["content_md5"])
    return V.encode_missing(t.spread("documents").select("doc_id", "text"), cache, "text", hashing_encoder).select("doc_id", "content_md5", "cached", F.size("embedding").alias("dims"))


@query("vec_06_encode", """
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents), h AS (SELECT doc_id, md5(w) AS m FROM tk),
b AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(m, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
SELECT doc_id, slot::INT AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4)::DOUBLE AS v FROM b WHERE v <> 0""")
def encode(t: Inputs):
    """The default encoder, as sparse rows. The tokens are letters and digits."""
    d = t.spread("documents").select("doc_id", F.posexplode(hashing_encoder(F.col("text"))).alias("slot", "v")).where("v <> 0")
    return d.select("doc_id", "slot", F.round(F.col("v").cast("double"), 4).alias("v"))


@query("vec_07_similar_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4""")
def similar_pairs(t: Inputs):
    return V.similar_pairs(corpus(t).select("id", "embedding"), 0.4, copies=True)
