"""User function surface: table function, Arrow functions, aggregate, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strategies as ST
from ..functions import udx
from ..functions.chunking import word_chunks
from ..functions.digests import canonical_json
from ..functions.encoders import encoder, hash_batch
from ..functions.textdiff import change_percentage
from .registry import Inputs, query


@query("udf_01_html_nodes", """
SELECT page_id, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<a ')) AS a, len(regexp_extract_all(html, '<p>')) AS p FROM pages""")
def html_nodes(t: Inputs):
    """The table function from SQL."""
    udx.register_all(t.spark)
    t.pages.createOrReplaceTempView("pagelore_pages")
    return t.spark.sql("""SELECT page_id, count_if(tag = 'li') AS li, count_if(tag = 'a') AS a, count_if(tag = 'p') AS p
                          FROM pagelore_pages, LATERAL html_nodes(html) GROUP BY page_id""")


@query("udf_02_word_chunks")
def word_cuts(t: Inputs):
    return t.documents.select("doc_id", F.posexplode(word_chunks(500, 50)(F.col("text"))).alias("idx", "chunk")).select("doc_id", "idx", F.length("chunk").alias("n"))


@query("udf_03_canonical_json", """
SELECT event_id, '{"a":[1,2],"k":' || json_extract_string(props, '$.k') || ',"z":"\\u00e9"}' AS canonical FROM events""")
def canonical(t: Inputs):
    return t.events.select("event_id", canonical_json(F.regexp_replace("props", r"^\{", '{ "z" : "é", "a": [1, 2] ,')).alias("canonical"))


@query("udf_04_change_percentage", "SELECT doc_id, 0.0::DOUBLE AS same, 100.0::DOUBLE AS gone FROM documents WHERE text <> ''")
def change(t: Inputs):
    return t.documents.where("text <> ''").select("doc_id", change_percentage(F.col("text"), F.col("text")).alias("same"), change_percentage(F.col("text"), F.lit("")).alias("gone"))


@query("udf_05_encoder_hook", "SELECT doc_id, 32 AS dims FROM documents")
def encoder_hook(t: Inputs):
    """Another batch encoder in the place of the default one."""
    enc = encoder(lambda texts: hash_batch(texts, 32), batch=64)
    return t.documents.select("doc_id", F.size(enc(F.col("text"))).alias("dims"))


@query("udf_06_ewma", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN rn = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - rn) END), 5) AS ewma FROM r GROUP BY 1""")
def ewma(t: Inputs):
    """The exponential mean over groups of any size; the pandas aggregate for bounded groups is checked against it in the tests."""
    from ..operators.windows import ewma as exact
    e = exact(t.events.select("user_id", "event_id", "value"), ["user_id"], F.floor(F.col("event_id") / 1_000_000), [F.col("event_id")], "value")
    return e.select("user_id", F.round("ewma", 5).alias("ewma"))


@query("udf_07_registry", """
SELECT page_id, NOT contains(url, 'spam') AS domain_ok, round((contains(lower(url), 'blog'))::INT / 1, 6)::DOUBLE AS keywords FROM pages""")
def registry(t: Inputs):
    u = F.col("url")
    return t.pages.select("page_id", ST.URL_FILTERS["domain"](u, blocked=["spam"]).alias("domain_ok"), ST.URL_SCORERS["keywords"](u, ["blog"]).alias("keywords"))
