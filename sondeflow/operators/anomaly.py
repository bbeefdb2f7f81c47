"""Unusual days and runs of unusual days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ratio, rounded
from .temporal import daily_means_calendar


def high_days(
    days: DataFrame,
    z_threshold: float = 3.0,
    date_column: str = "date",
    value_column: str = "value",
    digits: int | None = 2,
) -> DataFrame:
    """Days far above the mean of all days, by population deviation.

    One-sided. The statistics are a window over the days.
    """
    value, every = F.col(value_column), Window.partitionBy()
    mean, deviation = F.avg(value).over(every), F.stddev_pop(value).over(every)
    return (
        days.withColumn("__mean", mean)
        .withColumn("__z", ratio(value - F.col("__mean"), deviation))
        .where(F.col("__z") > z_threshold)
        .select(
            date_column,
            rounded(value, digits).alias(value_column),
            rounded(F.col("__mean"), digits).alias("overall_mean"),
            rounded(F.col("__z"), digits).alias("z_score"),
        )
        .orderBy(F.col("z_score").desc(), date_column)
    )


def _flag(z: Column, threshold: float) -> Column:
    return F.coalesce(F.abs(z) > threshold, F.lit(False))


def flag_anomalous_days(
    days: DataFrame,
    z_threshold: float = 3.0,
    value_column: str = "value",
) -> DataFrame:
    """Add ``is_flagged``: far from the mean on either side, by sample deviation.

    Days without a value are not flagged, nor is any day of a constant series.
    """
    value, every = F.col(value_column), Window.partitionBy()
    z = ratio(value - F.avg(value).over(every), F.stddev_samp(value).over(every))
    return days.withColumn("is_flagged", _flag(z, z_threshold))


def find_streaks(
    days: DataFrame,
    flag_column: str = "is_flagged",
    min_length: int = 2,
    date_column: str = "date",
    value_column: str | None = None,
    gap_breaks: bool = False,
    digits: int | None = 2,
) -> DataFrame:
    """Runs of flagged days: first day, last day, length, mean value on request.

    A day that is present and not flagged ends a run. A missing day ends it only
    with ``gap_breaks``, or when the calendar is full and missing days are there
    as unflagged rows. Runs are in date order.
    """
    flagged = F.coalesce(F.col(flag_column), F.lit(False))
    in_order = Window.orderBy(date_column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.count_if(~flagged).over(in_order)
    runs = days.withColumn("__run", run).where(flagged)
    keys = ["__run"]
    if gap_breaks:
        position = F.row_number().over(Window.orderBy(date_column))
        runs = runs.withColumn("__island", F.date_sub(date_column, position))
        keys.append("__island")
    measured = [] if value_column is None else [
        rounded(F.avg(value_column), digits).alias("streak_mean")
    ]
    return (
        runs.groupBy(*keys)
        .agg(
            F.min(date_column).alias("streak_start"),
            F.max(date_column).alias("streak_end"),
            F.count(F.lit(1)).alias("streak_length_days"),
            *measured,
        )
        .where(F.col("streak_length_days") >= min_length)
        .drop(*keys)
        .orderBy("streak_start")
    )


def high_streaks(
    days: DataFrame,
    threshold: float = 10.0,
    min_length: int = 2,
    date_column: str = "date",
    value_column: str = "value",
    gap_breaks: bool = False,
    digits: int | None = 2,
) -> DataFrame:
    """Runs of days above a threshold with their mean, longest first."""
    flags = days.withColumn("__high", F.col(value_column) > threshold)
    return find_streaks(
        flags, "__high", min_length, date_column, value_column, gap_breaks, digits
    ).orderBy(F.col("streak_length_days").desc(), "streak_start")


def _days_by_parameter(
    df: DataFrame, columns: Sequence[str], timestamp_column: str, resolution: int | None
) -> DataFrame:
    daily = daily_means_calendar(df, columns, timestamp_column, resolution)
    return daily.unpivot(["date"], list(columns), "parameter", "value")


def flagged_days(
    df: DataFrame,
    columns: Sequence[str],
    z_threshold: float = 3.0,
    timestamp_column: str = "timestamp",
    resolution: int | None = None,
) -> DataFrame:
    """Every calendar day of every column with its two-sided anomaly flag.

    The statistics are a window over the days of each column.
    """
    days = _days_by_parameter(df, columns, timestamp_column, resolution)
    value, every = F.col("value"), Window.partitionBy("parameter")
    z = ratio(value - F.avg(value).over(every), F.stddev_samp(value).over(every))
    return days.select("parameter", "date", "value", _flag(z, z_threshold).alias("is_flagged"))


def flagged_day_counts(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flagged days per column, most first, ties in column order."""
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("parameter"))
    return (
        flagged.groupBy("parameter").agg(F.count_if("is_flagged").alias("flagged_days"))
        .orderBy(F.col("flagged_days").desc(), position)
    )


def most_flagged_days(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The flagged dates of the column that has most of them."""
    top = flagged_day_counts(flagged, columns).limit(1).select("parameter")
    return (
        flagged.where("is_flagged").join(F.broadcast(top), "parameter", "left_semi")
        .select("parameter", F.date_format("date", "yyyy-MM-dd").alias("flagged_date"), "value")
        .orderBy("flagged_date")
    )
