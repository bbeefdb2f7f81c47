"""From raw documents to packed training sequences, stage by stage.

Each stage reads all that the one before has kept, from Parquet in the folder that
all executors share. A stage handles what its operator handles: see the operators'
docstrings for missing values, empty and very long texts, ties, repeated rows, empty
tables and extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sondeflow.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from sondeflow.llm.queries import ready, table
from sondeflow.llm.store import saved


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_passing(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, that of the largest id."""
    return exact_dedup.keep_largest(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id."""
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, from not at all to three times."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: In order: (name, function of (spark, docs, folder of the tables)).
STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokens and links are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
