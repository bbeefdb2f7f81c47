"""Mix sources to target weights by hash thresholds, without sorting documents.

Every document has a fixed place in hash order. A source that is to give ``k`` times
its words takes all its documents ``floor(k)`` times and, once more, those below a
threshold whose words come nearest to the rest. Thresholds are nested: a document
taken ``n + 1`` times is also one that is taken ``n`` times. They are found from
histograms: words per source and hash bucket, then the same inside the one bucket
where the budget ends, until that bucket holds a single hash value. Each level is a
partial aggregate over what the last one left open. Built from DataFrame functions.

Defined results: sources are weighted in code-point order, a missing source last.
No source gives more than three times its words; what it can not give is shared
among the others by weight. A missing text has no words. Repeated ids have one hash
and are taken or left together. Sources of no words, and an empty table, give
targets of 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import saved
from .words import word_count

#: Times that a document may be taken at most.
MOST_REPEATS = 3

#: Weights of the sources in order, repeated from the start.
WEIGHTS = (1, 2, 3)

#: Bits of the hash order, and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 10


def hash_order(column: str) -> Column:
    """A fixed pseudo-random place in ``[0, 2**60)``, the same in any SQL engine."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``(doc_id, source, size, place)``, written once: the only reading of the texts."""
    return saved(docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        word_count(text_column).alias("size"),
        hash_order(id_column).alias("place"),
    ), "sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)``; one row per source, in one task.

    Sources are filled in the order in which they reach their limit: the level of
    the others is known as soon as the next one stays below its own.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    nth = (F.row_number().over(named) - 1) % len(weights)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "*", F.get(F.array(*map(F.lit, weights)), nth).cast("double").alias("weight"),
        (MOST_REPEATS * F.col("source_size")).cast("double").alias("most"),
    )
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1))
    shared = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    totals = totals.select(
        "source", "source_size", "weight", "most", shared.alias("rest_weight"),
        (F.sum("source_size").over(everything) - F.coalesce(before, F.lit(0.0))).alias("rest_size"),
    )
    full = F.col("most") * F.col("rest_weight") <= F.col("weight") * F.col("rest_size")
    level_size = F.max(F.when(~full, F.col("rest_size"))).over(everything)
    level_weight = F.max(F.when(~full, F.col("rest_weight"))).over(everything)
    return totals.select(
        "source", "source_size",
        F.when(full, F.col("most")).otherwise(F.col("weight") * level_size / level_weight).alias("target"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target, whole, threshold)``.

    A document is taken ``whole`` times, and once more if its place is at most
    ``threshold``.
    """
    targets = source_targets(sizes, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = saved(targets.withColumn("whole", whole.cast("long")), "targets")
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    edges = targets.select(
        F.col("source").alias("s"), wanted.alias("wanted"),
        F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"),
    )
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        width = 1 << (HASH_BITS - LEVEL_BITS * level)
        step = F.expr(f"(place - low) DIV {width}L")
        # documents of the open bucket only; its counts start where the last level ended
        inside = (F.col("place") >= F.col("low")) & (step < 1 << LEVEL_BITS)
        counted = (
            sizes.join(edges, _same("source", "s")).where(inside)
            .groupBy("s", "wanted", "low", "below", step.alias("step"))
            .agg(F.sum("size").alias("words"), F.min("place").alias("first"), F.max("place").alias("last"))
        )
        order = Window.partitionBy("s").orderBy("step")
        reached = F.col("below") + F.sum("words").over(order)
        over = counted.withColumn("reached", reached).where("reached > wanted")
        edge = over.groupBy("s").agg(F.min_by(F.struct(
            "wanted", (F.col("low") + F.col("step") * width).alias("low"),
            (F.col("reached") - F.col("words")).alias("below"), "words", "first", "last",
        ), "step").alias("edge"))
        edges = saved(edge.select("s", "edge.*"), "edges")
        if edges.where("first <> last").isEmpty():
            break
        edges = edges.select("s", "wanted", "low", "below")
    nearer = F.col("below") + F.col("words") - F.col("wanted") < F.col("wanted") - F.col("below")
    limits = edges.select("s", F.when(nearer, F.col("last")).otherwise(F.col("last") - 1).alias("threshold"))
    plan = targets.join(limits, _same("source", "s"), "left").drop("s")
    return saved(plan.withColumn("threshold", F.coalesce("threshold", F.lit(-1).cast("long"))), "plan")


def _repeats(place: Column) -> Column:
    return F.col("whole") + F.when(place <= F.col("threshold"), 1).otherwise(0)


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document."""
    sizes = measured(docs, id_column, text_column, source_column)
    plan = mixing_plan(sizes, weights).withColumnRenamed("source", "s")
    return sizes.join(plan, _same("source", "s")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * _repeats(F.col("place"))).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    The plan has a row per source. Written before it is joined, its size is known,
    and only a small one is broadcast; a longer list of sources is joined by shuffle.
    """
    plan = mixing_plan(measured(docs, id_column, text_column, source_column), weights)
    plan = plan.select(F.col("source").alias("__source"), "whole", "threshold")
    names = {"whole": "__whole", "threshold": "__threshold"}
    times = F.col("__whole") + F.when(hash_order(id_column) <= F.col("__threshold"), 1).otherwise(0)
    joined = docs.join(plan.withColumnsRenamed(names), F.col(source_column).eqNullSafe(F.col("__source")))
    return (
        joined.withColumn("__times", times.cast("int")).where("__times > 0")
        .select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__times"))).alias("__time"))
        .drop("__time")
    )
