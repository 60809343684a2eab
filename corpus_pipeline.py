"""Corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, token ids.

Every stage is (name, function of session, documents and input folder). Its result is written and read again as the
documents of the next; all but the last give the columns of `documents`.

Cases: null ids, texts and sources go through as the operators define them. Rows without an id cannot name a group
and stay; of rows that repeat an id and text, near-duplicate removal keeps one; of an id with different texts each goes
or stays by its own group.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import decontamination, factorisation, mixing, shingle_overlap, token_output
from pagelore.session import free_name, scratch_path, ship_package, write_and_read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least one half stay."""
    ship_package(spark)
    model = factorisation.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return factorisation.with_score(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, linked by five-word shingles that overlap by 0.8 or more, the document with the smallest id stays.

    Close copies come from op4's search over SimHash fingerprints, each verified on its shingles; a prefix filter finds the rest.
    """
    ship_package(spark)
    return shingle_overlap.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    ship_package(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of its source ask for."""
    ship_package(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard files of token ids, and per document what they hold."""
    ship_package(spark)
    to = scratch_path(spark, "tokens")
    token_output.write_tokens(docs, to, VOCABULARY)
    return token_output.token_digests(spark, to)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("token_ids", token_ids)]

# models, fingerprints, edit distance and the tokenizer are beyond SQL; the tests compare with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
