"""Bounded samples of labelled documents, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_column: str, buckets: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a missing id is not held out."""
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % buckets
    return F.coalesce(rest == remainder, F.lit(False))


def class_sizes(labels: DataFrame) -> dict[int, int]:
    """Number of labelled documents per class."""
    return {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}


def training_labels(labels: DataFrame, column: str, buckets: int, remainder: int) -> DataFrame:
    """``(doc_id, label)`` of the documents that may be learnt from.

    A document that is labelled more than once has the smallest of its labels.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out("doc_id", buckets, remainder))
    return known.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))


def sampled_examples(
    docs: DataFrame, labels: DataFrame, sizes: dict[int, int], most: dict[int, int]
) -> DataFrame:
    """``(doc_id, label, text)`` of about ``most[label]`` labelled documents per class.

    A hash of the id picks them, so reruns agree; the sample is what ``most`` says
    whatever the size of the corpus, which bounds the broadcast.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    limit = F.lit(0).cast("long")
    for label, size in sizes.items():
        share = min(1.0, most.get(label, 0) / size)
        limit = F.when(F.col("label") == label, F.lit(int(share * (1 << 40)))).otherwise(limit)
    chosen = labels.where(place < limit)
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
