"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

A text is unique if its length is, or if its prefix hash is within its length; only
what survives both is read and hashed in full. Counts are partial aggregates. What
survives a step is told to the next scan by a filter of fixed size, which is
broadcast, so that no text is shuffled to find its group. Built from DataFrame
functions only.

Defined results: a missing text is empty, and equal to other empty ones. Of equal
texts the row with the largest id stays; an id of NULL stays only where its group
has no other. Of rows that repeat both id and text one stays. Every row is counted and
reported. No text is changed before it is compared. Other columns do not matter to the
groups; maps among them are compared as JSON. No document: no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import comparable, flagged, maybe_in, saved, slot_filter

#: Characters of the prefix that the second step hashes.
PREFIX = 256

#: Slots of the filters of lengths and prefixes.
SLOTS = 1 << 24


def _whole(text_column: str) -> Column:
    return F.coalesce(F.col(text_column).cast("string"), F.lit(""))


def _with_keys(docs: DataFrame, text_column: str) -> DataFrame:
    text = _whole(text_column)
    return docs.withColumns({
        "__bytes": F.octet_length(text),
        "__prefix": F.xxhash64(F.octet_length(text), F.substring(text, 1, PREFIX)),
    })


def refine(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Filter of the prefix hashes that may occur twice.

    Lengths are counted first, and prefixes only among texts of a repeated length.
    """
    keys = _with_keys(docs, text_column).select("__bytes", "__prefix")
    lengths = slot_filter(keys.groupBy("__bytes").count().where("count > 1"), "__bytes", slots=SLOTS)
    candidates = maybe_in(keys, lengths, "__bytes", slots=SLOTS)
    prefixes = candidates.groupBy("__prefix").count().where("count > 1")
    return saved(slot_filter(prefixes, "__prefix", slots=SLOTS), "prefixes")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(text_sha256, keep_id, group_size)`` of every text that several rows have."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    survivors = maybe_in(_with_keys(narrow, "text"), refine(narrow), "__prefix", slots=SLOTS)
    return (
        survivors.groupBy(F.sha2(_whole("text"), 256).alias("text_sha256"))
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


#: Rows that repeat id and text and are written back by one task.
REPEATED_ROWS = 10_000


def _every_copy(documents: DataFrame) -> DataFrame:
    """Rows that repeat id and text, from their ``copies``: ``first`` is true for one of them."""
    few = documents.where(F.col("copies") <= REPEATED_ROWS).withColumn("from", F.lit(0).cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(REPEATED_ROWS).cast("long"))
    many = documents.where(F.col("copies") > REPEATED_ROWS).withColumn("from", F.explode(parts)).repartition("doc_id", "from")
    last = F.least(F.col("from") + REPEATED_ROWS, F.col("copies")) - 1
    rows = few.unionByName(many).withColumn("nth", F.explode(F.sequence(F.col("from"), last)))
    return rows.withColumn("first", F.col("nth") == 0).drop("copies", "from", "nth")


def mark_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every document.

    A unique text is its own group. The hash of every text is part of the result and
    is taken in the scan; what is shuffled are ids and hashes. Copies are counted
    before they are shuffled. The groups are written first: then their size is known,
    and in a join that is not a broadcast adaptive execution can split the side of a
    group that is too large for a task.
    """
    groups = saved(duplicate_groups(docs, id_column, text_column), "groups")
    documents = _every_copy(docs.groupBy(
        F.col(id_column).alias("doc_id"), F.sha2(_whole(text_column), 256).alias("text_sha256")
    ).agg(F.count(F.lit(1)).alias("copies")))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return documents.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def keep_largest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row per text, that of the largest id.

    A text that the refinement finds unique stays where it is. The others meet by
    their full hash; each task sends one row per text at most, however many copies
    it has read. Of rows that repeat the id too, the one with the largest other
    columns stays.
    """
    others = comparable(docs, [c for c in docs.columns if c not in (id_column, text_column)])
    marked = flagged(
        _with_keys(docs, text_column), "__maybe", refine(docs, text_column), "__prefix", slots=SLOTS
    )
    best = F.max_by(F.struct(*docs.columns), F.struct(id_column, *others)).alias("best")
    kept = (
        marked.where("__maybe").groupBy(F.sha2(_whole(text_column), 256).alias("sha"))
        .agg(best).select("best.*")
    )
    return marked.where("NOT __maybe").select(*docs.columns).unionByName(kept)
