"""Joining moments with a table of intervals that may overlap, by equal keys.

An interval of some length is put into the one or two bins, of a width next above that
length, that hold its ends; a moment looks into its bin of every width that occurs. So
the join is one on equal keys, which shuffles and splits like any other, where a
condition on an order would compare all moments with all intervals. There are at most
some thirty widths, since each is four times the one before, and a bin holds few
intervals that do not cover a moment in it.

The pairs grow with both tables, where the time they span does not. Sums over the moments
of each interval need no pairs: they are the running sums at its end less those before
its start, so bounds are sorted in among the moments, block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scale import attach
from .series import in_blocks

#: Powers of two between one width and the next.
STEP = 2


def _micros(moment: str | Column) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    return F.unix_micros(column.cast("timestamp"))


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _bounded(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals with bounds in microseconds; those without a moment are left out."""
    low, high = _micros(start), _micros(end)
    return intervals.withColumns({"__low": low, "__high": high}).where(F.col("__low") <= F.col("__high"))


def _binned(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals in their bins."""
    bounded = _bounded(intervals, start, end)
    length = F.col("__high") - F.col("__low") + 1
    level = (F.ceil(F.log2(length.cast("double")) / STEP) * STEP).cast("int")
    bins = F.array_distinct(F.array(*[_shifted(F.col(c), F.col("__level")) for c in ("__low", "__high")]))
    return bounded.withColumn("__level", level).withColumn("__bin", F.explode(bins))


def covering(
    moments: DataFrame, moment: str, intervals: DataFrame, start: str = "start", end: str = "end",
    how: str = "inner",
) -> DataFrame:
    """Each row of ``moments`` with each interval, closed on both sides, that covers it.

    ``how="left"`` keeps the rows that none covers, with missing interval columns. A
    missing moment is covered by none; an interval without start or end, or that ends
    before it starts, covers none. Column names of both tables must differ.
    """
    if how == "left":
        # moments that many rows share are looked up once
        places = moments.select(F.col(moment).alias("__moment")).distinct()
        found = covering(places, "__moment", intervals, start, end)
        return moments.join(found, F.col(moment) == F.col("__moment"), "left").drop("__moment")
    # an interval of each width at least: one row per width
    binned = _binned(intervals, start, end)
    levels = sorted(r["__level"] for r in binned.select("__level").distinct().collect())
    if not levels:
        levels = [0]
    probes = moments.withColumn("__at", _micros(moment)).withColumn(
        "__level", F.explode(F.array(*[F.lit(level) for level in levels]))
    )
    probes = probes.withColumn("__bin", _shifted(F.col("__at"), F.col("__level")))
    joined = probes.join(binned, ["__level", "__bin"]).where(F.col("__at").between(F.col("__low"), F.col("__high")))
    return joined.drop("__at", "__level", "__bin", "__low", "__high")


def sums_inside(
    moments: DataFrame, moment: str, sums: Sequence[str], intervals: DataFrame, key: str,
    start: str = "start", end: str = "end",
) -> DataFrame:
    """``(key, <sum> ...)``: whole numbers of ``moments`` added up over the intervals of each key.

    What :func:`covering` followed by a sum per key gives, as ``decimal(38,0)``, and 0 where
    an interval covers nothing; a key whose intervals could cover nothing is left out.
    Moments that many rows share are one row in the order.
    """
    totals = moments.groupBy(_micros(moment).alias("__at")).agg(*[F.sum(c).alias(c) for c in sums])
    # at a bound all moments up to it are counted, so that of the start is one before it
    bounds = F.array(
        F.struct((F.col("__low") - 1).alias("__at"), F.lit(-1).alias("__sign")),
        F.struct(F.col("__high").alias("__at"), F.lit(1).alias("__sign")),
    )
    marks = _bounded(intervals, start, end).select(F.col(key).alias("__key"), F.inline(bounds))
    order = ["__at", "__turn"]
    blocks = in_blocks(
        totals.where("__at IS NOT NULL").withColumn("__turn", F.lit(0).cast("bigint")).unionByName(
            marks.withColumn("__turn", F.pmod(F.xxhash64("__key"), F.lit(1 << 40)) + 1), allowMissingColumns=True
        ),
        [], order,
    )
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("__block").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "__block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums]
    )
    upto = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.select(
        "__key", "__sign", "__block", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in sums]
    ).where(F.col("__sign").isNotNull())
    return attach(running, offsets, ["__block"]).groupBy(F.col("__key").alias(key)).agg(*[
        F.sum(F.col("__sign") * (F.col(c) + F.col(f"__before_{c}")).cast("decimal(38,0)")).alias(c) for c in sums
    ])
