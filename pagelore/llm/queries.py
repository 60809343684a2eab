"""The registered queries op1 to op13, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import conversations, decontamination, factorisation, html_template, mixing, pii, quality_rules, simhash, token_output, toxicity, url_templates, warc_archive, whitening
from .registry import query, table


@query("op1_token_output")
def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written to shard files in ascending document order and read back."""
    to = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, folder, "documents"), to, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.token_digests(spark, to)


@query("op2_quality_rules", quality_rules.SQL)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, ratios and verdict of the threshold table for every document."""
    j = quality_rules.judge(table(spark, folder, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_mixing", mixing.SQL)
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mix takes every document, and what that makes in words."""
    return mixing.mix_report(table(spark, folder, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_template.main_text(table(spark, folder, "pages"))


@query("op9_warc_archive", warc_archive.SQL)
def op9_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived, and what the records say when the archive is read back."""
    to = scratch_path(spark, "warc")
    warc_archive.write_archive(table(spark, folder, "pages"), to)
    return warc_archive.read_index(spark, to)


@query("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    return pii.personal_data(table(spark, folder, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark text, with the place and the number of edits."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_url_filters", url_templates.sql())
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address; labels come from the document whose number the address ends in."""
    pages = table(spark, folder, "pages")
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+|/)?$", 1)
    known = pages.select("url", F.nullif(number, F.lit("")).cast("long").alias("doc_id")).where("doc_id is not null")
    quality = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    j = url_templates.judge(pages, known.join(quality, "doc_id").select("url", "label"))
    return j.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return factorisation.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, with its nearest labelled examples."""
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the sixteen first whitened components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_conversation_repair", conversations.SQL)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return conversations.repair(table(spark, folder, "conversations"))
