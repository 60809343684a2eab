"""BM25 over postings, corpus-wide or inside each page; reranking, session bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, text_tokens
from ..session import write_and_read
from .skew import previous_row, top_per_key

# Okapi parameters; a negative idf becomes eps times the mean idf.
K1, BM_B, EPS = 1.5, 0.75, 0.25


def postings(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, tok, tf, dl). A document's tokens stay in one task until counted, so the exchange carries
    one row per distinct term of a document."""
    d = docs.select(*keys, tokens.alias("_t"))
    return (d.select(*keys, F.size("_t").alias("dl"), F.explode("_t").alias("tok"))
            .groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")))


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - BM_B + BM_B * dl / avgdl))


def bm25_corpus(post: DataFrame, queries: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, score) for every pair that shares a term.

    The query terms with their weights are written, so Spark knows their size: a small table goes to the tasks that
    hold the postings, and over postings in buckets by document each score is complete inside its partition. A best-k
    filter on top then sends k rows of a query and partition. A larger table is joined by a shuffle on the term. The
    corpus numbers are scalar subqueries, so nothing passes through the driver.
    """
    per_doc = post.groupBy(doc).agg(F.first("dl").alias("dl"))
    n_docs, avgdl = per_doc.agg(F.count(F.lit(1))).scalar(), per_doc.agg(F.avg("dl")).scalar()
    df = post.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", _idf(n_docs, F.col("df")))
    mean_idf = df.agg(F.avg("idf")).scalar()
    idf = df.select("tok", F.when(F.col("idf") < 0, mean_idf * EPS).otherwise(F.col("idf")).alias("idf"))
    q = queries.groupBy(query, "tok").agg(F.count(F.lit(1)).alias("qtf"))
    # pulling the idf in on the query side keeps the second join free of a third table
    terms = write_and_read(q.join(idf, "tok"), "terms")
    hit = post.join(terms, "tok")
    return hit.groupBy(query, doc).agg(F.sum(F.col("qtf") * F.col("idf") * _gain(F.col("tf"), F.col("dl"), avgdl)).alias("score"))


def bm25_inside(blocks: Column, query: Column) -> Column:
    """array<struct<i, score>>: BM25 of the blocks (arrays of tokens) of a page that share a token with the query, the page being the corpus.

    Everything is counted in the page's row: its tokens, one of each block, are sorted once, so that the length of a run is the
    number of blocks that hold it. No token leaves the row.
    """
    occurs = lambda arr, tok: F.size(arr) - F.size(F.array_remove(arr, tok))

    def weights(q, n, held, at):
        idf = F.transform(at, lambda s, k: F.struct(F.get(held, s).alias("tok"), _idf(n, F.coalesce(F.get(at, k + 1), F.size(held)) - s).alias("idf")))

        def of_query(all_idf):
            mean = F.aggregate(all_idf, F.lit(0.0), lambda s, x: s + x["idf"]) / F.greatest(F.size(all_idf), F.lit(1))
            return let(mean, lambda m: F.transform(F.filter(all_idf, lambda x: F.array_contains(q, x["tok"])), lambda x: F.struct(
                x["tok"].alias("tok"), (occurs(q, x["tok"]) * F.when(x["idf"] < 0, m * EPS).otherwise(x["idf"])).alias("w"))))

        return let(idf, of_query)

    def scored(bs, q, st, w):
        def score(b, hit):
            return F.when(F.size(hit) > 0, F.aggregate(w, F.lit(0.0), lambda s, x: s + x["w"] * _gain(occurs(hit, x["tok"]), F.size(b), st["avgdl"])))

        each = F.transform(bs, lambda b, i: F.struct(i.alias("i"), let(F.filter(b, lambda t: F.array_contains(q, t)), lambda hit: score(b, hit)).alias("score")))
        return F.filter(each, lambda x: x["score"].isNotNull())

    def run(bs, q):
        n = F.size(F.filter(bs, lambda b: F.size(b) > 0))
        stats = F.struct(n.alias("n"), (F.aggregate(bs, F.lit(0).cast("long"), lambda s, b: s + F.size(b)) / F.greatest(n, F.lit(1))).alias("avgdl"))
        held = F.sort_array(F.flatten(F.transform(bs, lambda b: F.array_distinct(b))))
        places = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        starts = lambda h: F.filter(places(h), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return let(stats, lambda st: let(held, lambda h: let(starts(h), lambda at: let(weights(q, st["n"], h, at), lambda w: scored(bs, q, st, w)))))

    return let(blocks, lambda bs: let(query, lambda q: run(bs, q)))


def best_blocks(scores: DataFrame, page: str, block: str, k: int = 10, threshold: float = 1.0) -> DataFrame:
    """Top k blocks over the threshold in document order, with the page relevance min(1, mean / 10)."""
    top = top_per_key(scores.where(F.col("score") >= threshold), [page], [F.col("score").desc(), F.col(block)], k)
    w = Window.partitionBy(page)
    return (top.withColumn("relevance", F.least(F.lit(1.0), F.avg("score").over(w) / 10))
            .withColumn("position", F.row_number().over(w.orderBy(block))))


def query_tokens(c: Column, language: str = "en") -> Column:
    return text_tokens(c, language)


def rerank(hits: DataFrame, query: str, score: Column, tie: str, k: int) -> DataFrame:
    return top_per_key(hits.withColumn("rerank_score", score), [query], [F.col("rerank_score").desc(), F.col(tie)], k)


def next_queries(log: DataFrame, session: str, order: str, query: str, slice_col: Column, k: int = 5) -> DataFrame:
    """Successors of a query over all sessions: share of its followers, best k. Long sessions are cut into slices."""
    pairs = previous_row(log.select(session, order, query), [session], slice_col, [F.col(order)], [query])
    n = (pairs.where(F.col(f"prev_{query}").isNotNull())
         .groupBy(F.col(f"prev_{query}").alias("query"), F.col(query).alias("next_query")).agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("query").agg(F.sum("n").alias("total"))
    top = top_per_key(n, ["query"], [F.col("n").desc(), F.col("next_query")], k)
    return top.join(total, "query").withColumn("confidence", F.col("n") / F.col("total"))
