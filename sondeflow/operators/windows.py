"""Moving and cumulative means, ranks, and deviations from the day.

Windows without a partition key run over days or months only. The date type
bounds those tables whatever the number of readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rounded, steady_mean
from ..scale import attach


def rolling_mean(
    days: DataFrame,
    rows: int = 7,
    date_column: str = "date",
    value_column: str = "value",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Mean of a day and the ``rows - 1`` days before it that are present."""
    frame = Window.orderBy(date_column).rowsBetween(-(rows - 1), Window.currentRow)
    mean = rounded(steady_mean(value_column, resolution, over=frame), digits)
    return days.withColumn("rolling_mean", mean).orderBy(date_column)


def cumulative_mean(
    days: DataFrame,
    date_column: str = "date",
    value_column: str = "value",
    digits: int | None = 2,
) -> DataFrame:
    """Mean of the daily means up to and including each day."""
    frame = Window.orderBy(date_column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col(value_column)
    return (
        days.withColumn("cumulative_mean", rounded(F.avg(value).over(frame), digits))
        .withColumn(value_column, rounded(value, digits))
        .orderBy(date_column)
    )


def rank_months(
    df: DataFrame,
    column: str,
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Months ranked by their unrounded mean, highest first, gaps after ties."""
    months = (
        df.where(F.col(column).isNotNull())
        .groupBy(year_column, month_column)
        .agg(steady_mean(column, resolution).alias("mean"))
    )
    return (
        months.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean").desc())))
        .withColumn("mean", rounded(F.col("mean"), digits))
        .orderBy("rank", year_column, month_column)
    )


def _with_day_mean(
    df: DataFrame,
    column: str,
    timestamp_column: str,
    resolution: int | None,
) -> DataFrame:
    """Put the mean of its day next to every non-missing reading.

    A window partitioned by day would hold a whole day in one task, and one day
    may hold much of the table. The daily means are aggregated and joined
    instead, by day number. A date has some four million values at most, and a
    century of days is below a megabyte, so the days are broadcast and readings stay
    where they were read.
    """
    readings = df.where(F.col(column).isNotNull()).withColumn(
        "__day", F.unix_date(F.to_date(timestamp_column))
    )
    days = readings.groupBy("__day").agg(steady_mean(column, resolution).alias("day_mean"))
    return attach(readings, days, ["__day"], broadcast=True).drop("__day")


def deviation_from_day(
    df: DataFrame,
    column: str,
    timestamp_column: str = "timestamp",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Difference of each reading from the mean of its day."""
    joined = _with_day_mean(df, column, timestamp_column, resolution)
    deviation = F.col(column) - F.col("day_mean")
    return joined.withColumns({
        "deviation": rounded(deviation, digits),
        "day_mean": rounded(F.col("day_mean"), digits),
    })


def largest_deviations(
    df: DataFrame,
    column: str,
    k: int = 15,
    timestamp_column: str = "timestamp",
    key: str = "record_number",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """The ``k`` readings furthest above the mean of their day."""
    joined = _with_day_mean(
        df.select(timestamp_column, key, column), column, timestamp_column, resolution
    )
    deviation = rounded(F.col(column) - F.col("day_mean"), digits)
    return (
        joined.withColumn("deviation", deviation)
        .orderBy(F.col("deviation").desc(), timestamp_column, key)
        .limit(k)
        .withColumn("day_mean", rounded(F.col("day_mean"), digits))
    )
