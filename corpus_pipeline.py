"""Corpus preparation: toxicity, language, exact copies, near copies, packing; each stage over all that was kept.

Cases, in every stage but the last: all columns of documents stay, extra ones too, whatever their names; an empty table
stays empty. A null text counts as empty: it isn't toxic, has no language and so goes with the second stage, as does an
empty one. Null ids are judged by their texts like others, and come last where the smallest id stays. Rows that repeat an
id and a text are copies, of which one stays. Very long texts are read whole. Packing gives no piece of what was dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.exact_dedup import drop_copies
from lodestar.llm.language_id import keep_identified
from lodestar.llm.packing import pack
from lodestar.llm.simhash_dedup import drop_near_copies
from lodestar.llm.toxicity import drop_toxic
from lodestar.session import discard, materialize, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one with the smallest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 1024 ids."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: Classifiers and tokenizers can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again; a stage's table goes once the next is there."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
