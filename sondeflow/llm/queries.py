"""The numbered operators bound to the test tables, one query each."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure
from . import (
    exact_dedup,
    license_scan,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    toxicity,
    training_order,
    whitening,
)
from .words import bound, whole_text, word_list

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings and the module path that tasks need.

    On a cluster the package is shipped with ``--py-files``; a session started from
    a checkout tells its Python workers where that is.
    """
    environment = spark.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        known = [p for p in (environment.get("PYTHONPATH"), _ROOT) if p]
        environment["PYTHONPATH"] = os.pathsep.join(known)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_query(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the whole of ``documents``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(table(ready(spark), sf_dir, "documents"))

    QUERIES[function.__name__] = run
    return function


@documents_query
def op6_parity_sketch_join(docs: DataFrame) -> DataFrame:
    links = ngram_join.link_components(docs)
    return links.withColumnRenamed("id", "doc_id")


@documents_query
def op9_best_fit_packing(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@documents_query
def op3_progressive_dedup(docs: DataFrame) -> DataFrame:
    return exact_dedup.mark_duplicates(docs)


@documents_query
def op8_hash_threshold_mix(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs)


@documents_query
def op10_rule_cascade(docs: DataFrame) -> DataFrame:
    return quality_rules.judge(docs)


def op7_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))


QUERIES["op7_nearest_toxic"] = op7_nearest_toxic


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"))


QUERIES["op2_subword_quality"] = op2_subword_quality


@documents_query
def op1_permutation_shards(docs: DataFrame) -> DataFrame:
    shards = [f"shard-{n:02d}" for n in range(32)]
    return sharding.place(docs.select("doc_id"), "doc_id", shards)


@documents_query
def op4_training_order(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return training_order.training_order(docs, path, key=0x5EED)


@documents_query
def op5_feistel_pseudonyms(docs: DataFrame) -> DataFrame:
    replaced = pii.replace_personal(docs, key=b"rotate this key for every release")
    return replaced.withColumn("n_spans", F.size("spans").cast("long"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where a tenth of the texts repeat a stretch from some word on.

    Which ones, from where and with what period follows from a checksum of the id. A
    missing id plants nothing.
    """
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(digest / 10).cast("long")

    def repeated(found: Column) -> Column:
        n = F.size(found)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % period))
        text = F.array_join(F.transform(order, lambda i: F.get(found, i)), " ")
        return F.when(n > 0, text).otherwise("")

    planted = F.when(digest % 10 == 0, bound(word_list("text"), repeated)).otherwise(whole_text("text"))
    return docs.select("doc_id", planted.alias("text"))


@documents_query
def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    found = periodic_runs.find_runs(_with_planted_periods(docs))
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)

    def greater(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, greater)).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pivoted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(ready(spark), sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


QUERIES["op12_pivoted_whitening"] = op12_pivoted_whitening


@documents_query
def op13_license_index(docs: DataFrame) -> DataFrame:
    base = [t.name for t in license_scan.BASE_TEMPLATES]

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    found = license_scan.scan(docs).withColumn("base", F.filter("matches", lambda m: m["template"].isin(base)))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").alias("first_word"), F.array_max("base.place").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("matches")).alias("labels"), "score",
    )
