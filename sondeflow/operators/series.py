"""Moving means, cumulative means and streaks over long series of readings.

A window over a whole series is one task, however long the series is. Here rows are
dealt into blocks of consecutive rows by a range partitioning, which a hot series,
day or timestamp does not upset, and written once. Each block is summarised by a small
state that can be merged: its totals, its last rows, or its runs with what touches
its edges. A window over the blocks of a series turns these states into what each block has to
know of those before it, and the rest happens inside the blocks.

Rows of one series need a complete order: rows that tie in ``order`` come in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import mean_of, rounded, steady_total
from ..scale import attach, materialized

#: Rows of a block, about.
BLOCK_ROWS = 1 << 18


def in_blocks(df: DataFrame, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``__block``: numbers that ascend along each series."""
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    ranged = df.repartitionByRange(blocks, *series, *order)
    return materialized(ranged.withColumn("__block", F.spark_partition_id()))


def _along(series: Sequence[str]) -> WindowSpec:
    """The blocks of a series in order."""
    return Window.partitionBy(*series).orderBy("__block")


def _inside(series: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of one block of a series in order."""
    return Window.partitionBy(*series, "__block").orderBy(*order)


def moving_mean(
    df: DataFrame, series: Sequence[str], order: Sequence[str], column: str, rows: int = 7,
    digits: int | None = 2, resolution: int = 2, name: str = "rolling_mean",
) -> DataFrame:
    """``df`` with the mean of a reading and the ``rows - 1`` before it in its series.

    Missing values take part as rows, not as values. Each block is given the last rows of
    those before it.
    """
    blocks = in_blocks(df, series, order)

    def last_rows(table: DataFrame) -> DataFrame:
        backwards = Window.partitionBy(*series, "__block").orderBy(*[F.desc(c) for c in order])
        return table.withColumn("__back", F.row_number().over(backwards)).where(F.col("__back") < rows).drop("__back")

    tails = last_rows(blocks).groupBy(*series, "__block").agg(F.collect_list(F.struct(*dict.fromkeys([*order, column]))).alias("__tail"))
    # blocks may be short, but so many hold a row each
    before = F.flatten(F.collect_list("__tail").over(_along(series).rowsBetween(-(rows - 1), -1)))
    carried = tails.select(*series, "__block", before.alias("__rows")).select(*series, "__block", F.inline("__rows"))
    carried = last_rows(carried)
    both = blocks.withColumn("__own", F.lit(True)).unionByName(carried.withColumn("__own", F.lit(False)), True)
    frame = _inside(series, order).rowsBetween(-(rows - 1), 0)
    mean = mean_of(steady_total(column, resolution, over=frame), F.count(column).over(frame), resolution)
    return both.withColumn(name, rounded(mean, digits)).where("__own").select(*df.columns, name)


def running_mean(
    df: DataFrame, series: Sequence[str], order: Sequence[str], column: str,
    digits: int | None = 2, resolution: int = 2, name: str = "cumulative_mean",
) -> DataFrame:
    """``df`` with the mean of all readings of the series up to and including each.

    Each block is given the total and the number of the readings before it.
    """
    blocks = in_blocks(df, series, order)
    sums = blocks.groupBy(*series, "__block").agg(
        steady_total(column, resolution).alias("__total"), F.count(column).alias("__n")
    )
    before = _along(series).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *series, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).cast("decimal(38,0)").alias("__total"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
    )
    frame = _inside(series, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(steady_total(column, resolution, over=frame), F.lit(0)).cast("decimal(38,0)") + F.col("__total")
    mean = mean_of(total, F.count(column).over(frame) + F.col("__n"), resolution)
    return attach(blocks, offsets, [*series, "__block"], null_keys=True).withColumn(
        name, rounded(mean, digits)
    ).select(*df.columns, name)


def series_streaks(
    df: DataFrame, series: Sequence[str], order: Sequence[str], flag: Column, min_length: int = 2,
    value_column: str | None = None, digits: int | None = 2, resolution: int = 2,
    longest_gap: float | None = None,
) -> DataFrame:
    """Runs of flagged readings per series: first and last time, length, mean on request.

    The first column of ``order`` is the time. A reading that is not flagged, or whose flag
    is missing, ends a run, and so does a gap of more than ``longest_gap`` seconds. A block's state
    are its runs; only those that touch its edges are merged with those of other blocks.
    """
    time = order[0]
    values = {"__value": F.col(value_column) if value_column else F.lit(None).cast("double")}
    rows = df.select(*series, *order, F.coalesce(flag, F.lit(False)).alias("__flag"), *[v.alias(k) for k, v in values.items()])
    blocks = in_blocks(rows, series, order)
    inside, whole = _inside(series, order), Window.partitionBy(*series, "__block")
    far = F.lit(False)
    if longest_gap is not None:
        gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(inside).cast("timestamp"))
        far = F.coalesce(gap > int(longest_gap * 1e6), F.lit(False))
    start = F.col("__flag") & (~F.coalesce(F.lag("__flag").over(inside), F.lit(False)) | far)
    runs = (
        blocks.withColumns({"__start": start, "__nth": F.row_number().over(inside), "__rows": F.count(F.lit(1)).over(whole)})
        .withColumn("__run", F.sum(F.col("__start").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where("__flag")
        .groupBy(*series, "__block", "__run").agg(
            F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("length"),
            steady_total("__value", resolution).alias("total"), F.count("__value").alias("n"),
            (F.min("__nth") == 1).alias("opens"), (F.max("__nth") == F.max("__rows")).alias("closes"),
        )
    )
    # which block of a series comes before, with or without runs
    present = blocks.select(*series, "__block").distinct().withColumn(
        "__before", F.lag("__block").over(_along(series))
    )
    runs = attach(runs, present, [*series, "__block"], null_keys=True)
    edges, inner = runs.where("opens OR closes"), runs.where("NOT (opens OR closes)")
    along = Window.partitionBy(*series).orderBy("__block", "__run")
    joined = F.col("opens") & F.lag("closes").over(along) & (F.lag("__block").over(along) == F.col("__before"))
    if longest_gap is not None:
        apart = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.lag("last").over(along).cast("timestamp"))
        joined = joined & (apart <= int(longest_gap * 1e6))
    merged = (
        edges.withColumn("__new", ~F.coalesce(joined, F.lit(False)))
        .withColumn("__group", F.sum(F.col("__new").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*series, "__group").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"),
            F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"),
        )
    )
    columns = [*series, "first", "last", "length", "total", "n"]
    found = inner.select(*columns).unionByName(merged.select(*columns)).where(F.col("length") >= min_length)
    mean = [rounded(mean_of(F.col("total"), F.col("n"), resolution), digits).alias("streak_mean")] if value_column else []
    return found.select(
        *series, F.col("first").alias("streak_start"), F.col("last").alias("streak_end"),
        F.col("length").alias("length"), *mean,
    )
