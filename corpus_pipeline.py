"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes the documents that the one before it kept, as stored, and returns
those it keeps, with the same columns; the last adds the token ids and the bytes that
they decode to. Every decision is made on all rows of the stage's input, and rows are
told apart by their place in it, so repeated and null ids are no trouble.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paneledger.llm import bpe, quality, set_join, spaced_seeds, surrogates
from paneledger.llm.registry import RANKS, SURROGATE_KEY
from paneledger.llm.text import table
from paneledger.workspace import keep


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, learnt from the labels of these documents."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return set_join.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return spaced_seeds.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data in their texts."""
    return surrogates.replaced(docs, SURROGATE_KEY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the bytes decoded from them."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality rules", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", clean), ("PII", private), ("byte-level BPE", encoded)]

# The quality trees and the tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
