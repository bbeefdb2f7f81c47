"""Sampling intervals and outages between consecutive readings.

The previous reading of every reading needs an order over the whole table. A
window over all readings would be one task, so time is cut into short slots:
order is needed inside a slot, between the slots of a longer unit, and so on up to
days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000
_MINUTE = 60 * MICROS
_DAY = 86_400 * MICROS


def _micros(timestamp_column: str) -> Column:
    return F.unix_micros(F.col(timestamp_column).cast("timestamp"))


def _floor(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step).cast("bigint"))


#: Slots are compared within ever longer units, so that no window has more than some
#: ten thousand rows, down to a limit of a microsecond.
_UNITS = (50_000, _MINUTE, _DAY)


def _between_slots(slots: DataFrame, width: int) -> DataFrame:
    """Gaps from the last reading of a slot to the first of the next slot.

    ``slots`` has one row per slot of ``width`` that holds readings: ``low, high`` in
    microseconds. Slots are compared within the next longer unit, then those units
    within the one after it, and days among themselves: the only unpartitioned window
    is over days.
    """
    gaps = []
    for unit in (u for u in _UNITS if u > width or u == _DAY):
        slots = slots.withColumn("unit", _floor(F.col("low"), unit))
        inside = Window.partitionBy("unit").orderBy("low")
        gaps.append(slots.select(F.lag("high").over(inside).alias("before"), F.col("low").alias("after")))
        slots = slots.groupBy("unit").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    gaps.append(slots.select(
        F.lag("high").over(Window.orderBy("low")).alias("before"), F.col("low").alias("after")
    ))
    return reduce(DataFrame.unionByName, gaps).where(F.col("before").isNotNull())


def gap_report(
    df: DataFrame,
    longer_than_seconds: float = 7200.0,
    timestamp_column: str = "timestamp",
) -> DataFrame:
    """Gaps longer than a limit: when each one ends and how long it lasted.

    Readings in one slot no wider than the limit cannot be further apart than
    the limit, so only the first and last reading of each slot matter. They are
    a partial aggregate; the readings themselves are neither shuffled nor
    sorted.
    """
    limit = round(longer_than_seconds * MICROS)
    width = min(max(limit, 1), _DAY)
    # slots end where a unit ends, so that each lies in one
    unit = min(u for u in _UNITS if u >= width)
    slots = (
        df.where(F.col(timestamp_column).isNotNull())
        .select(_micros(timestamp_column).alias("t"))
        .withColumn("unit", _floor(F.col("t"), unit))
        .groupBy("unit", _floor(F.col("t") - F.col("unit"), width).alias("slot"))
        .agg(F.min("t").alias("low"), F.max("t").alias("high"))
        .drop("unit")
    )
    length = F.col("after") - F.col("before")
    back = df.schema[timestamp_column].dataType
    return (
        _between_slots(slots, width)
        .where(length > limit)
        .select(
            F.timestamp_micros("after").cast(back).alias("gap_ends_at"),
            (length / F.lit(float(MICROS))).alias("gap_seconds"),
        )
        .orderBy("gap_ends_at")
    )


def interval_counts(
    df: DataFrame,
    k: int | None = 10,
    timestamp_column: str = "timestamp",
    unit_seconds: float | None = None,
) -> DataFrame:
    """How often each time between consecutive readings occurs, most first.

    ``unit_seconds`` rounds intervals down to whole units first. Equal
    timestamps are counted before the shuffle and give intervals of zero, so one
    timestamp with very many readings is one row, and a slot of a minute holds
    no more rows than it has microseconds.
    """
    times = (
        df.where(F.col(timestamp_column).isNotNull())
        .groupBy(_micros(timestamp_column).alias("t"))
        .agg(F.count(F.lit(1)).alias("copies"))
        # Always true; it makes both uses below need the same columns, so that
        # they share one scan and one shuffle.
        .where(F.col("copies") > 0)
        .withColumn("slot", _floor(F.col("t"), _MINUTE))
    )
    in_slot = Window.partitionBy("slot").orderBy("t")
    inner = times.select("copies", (F.col("t") - F.lag("t").over(in_slot)).alias("length"))
    # A reading follows its equal predecessor after no time at all; the first
    # copy follows the previous timestamp of the slot, if there is one.
    steps = inner.select(F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("length"), (F.col("copies") - 1).alias("n")),
        F.struct("length", F.lit(1).cast("bigint").alias("n")),
    ))).where(F.col("length").isNotNull() & (F.col("n") > 0))
    heads = (
        times.groupBy("slot").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    )
    between = _between_slots(heads, _MINUTE).select(
        (F.col("after") - F.col("before")).alias("length"), F.lit(1).cast("bigint").alias("n")
    )
    step = max(1, round((unit_seconds or 0) * MICROS))
    counted = (
        steps.unionByName(between)
        .groupBy(_floor(F.col("length"), step).alias("length"))
        .agg(F.sum("n").alias("occurrences"))
        .select((F.col("length") / F.lit(float(MICROS))).alias("interval_seconds"), "occurrences")
        .orderBy(F.col("occurrences").desc(), "interval_seconds")
    )
    return counted if k is None else counted.limit(k)
