"""Calendar aggregation: months, seasons, weekdays, hours and days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import month_index, ordinal, period, ratio, rounded, steady_mean
from ..schema import SEASONS, WEEKDAYS


def _means(columns: Sequence[str], digits: int | None, resolution: int | None) -> list:
    return [rounded(steady_mean(c, resolution), digits).alias(f"{c}_mean") for c in columns]


def monthly_coverage(
    df: DataFrame, year_column: str = "year", month_column: str = "month", day_column: str = "day"
) -> DataFrame:
    """Readings and days with readings per calendar month."""
    return (
        df.groupBy(year_column, month_column)
        .agg(
            F.count(F.lit(1)).alias("reading_count"),
            F.count_distinct(F.col(day_column)).alias("distinct_days_with_readings"),
        )
        .orderBy(year_column, month_column)
    )


def monthly_summary(
    df: DataFrame,
    columns: Sequence[str],
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = 2,
    resolution: int | None = None,
    null_groups: bool = True,
) -> DataFrame:
    """Mean, minimum and maximum of each column per calendar month.

    Readings without a time form a group of their own unless ``null_groups`` is
    off.
    """
    df = df if null_groups else df.dropna(subset=[year_column, month_column])
    statistics = []
    for c in columns:
        statistics += [
            rounded(steady_mean(c, resolution), digits).alias(f"{c}_mean"),
            rounded(F.min(c), digits).alias(f"{c}_min"),
            rounded(F.max(c), digits).alias(f"{c}_max"),
        ]
    return (
        df.groupBy(year_column, month_column).agg(*statistics)
        .orderBy(year_column, month_column)
    )


def monthly_means(
    df: DataFrame,
    columns: Sequence[str],
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = None,
    resolution: int | None = None,
) -> DataFrame:
    """Mean of each column per calendar month, with the period's date."""
    return (
        df.groupBy(year_column, month_column).agg(*_means(columns, digits, resolution))
        .withColumn("period", period(F.col(year_column), F.col(month_column)))
        .orderBy("period")
    )


def seasonal_summary(
    df: DataFrame,
    columns: Sequence[str],
    season_column: str = "season",
    digits: int | None = 2,
    resolution: int | None = None,
    counted: bool = True,
    null_groups: bool = True,
) -> DataFrame:
    """Readings and means per season, Summer to Spring, seasons present only.

    Readings without a known season form groups of their own unless
    ``null_groups`` is off.
    """
    df = df if null_groups else df.where(ordinal(season_column, SEASONS).isNotNull())
    count = [F.count(F.lit(1)).alias("reading_count")] if counted else []
    return (
        df.groupBy(season_column).agg(*count, *_means(columns, digits, resolution))
        .orderBy(ordinal(season_column, SEASONS))
    )


def weekday_summary(
    df: DataFrame,
    columns: Sequence[str],
    weekday_column: str = "day_of_week",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Readings and means per weekday, Monday to Sunday."""
    return (
        df.groupBy(weekday_column)
        .agg(F.count(F.lit(1)).alias("reading_count"), *_means(columns, digits, resolution))
        .orderBy(ordinal(weekday_column, WEEKDAYS))
    )


def hourly_cycle(
    df: DataFrame,
    columns: Sequence[str],
    hour_column: str = "hour",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Readings and means per hour of day."""
    return (
        df.groupBy(hour_column)
        .agg(F.count(F.lit(1)).alias("reading_count"), *_means(columns, digits, resolution))
        .orderBy(hour_column)
    )


def daily_mean(
    df: DataFrame,
    column: str,
    timestamp_column: str = "timestamp",
    digits: int | None = None,
    resolution: int | None = None,
) -> DataFrame:
    """Mean per day as ``(date, value)``, for the days that have values."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.to_date(timestamp_column).alias("date"))
        .agg(rounded(steady_mean(column, resolution), digits).alias("value"))
    )


def fill_calendar(days: DataFrame, columns: Sequence[str], date_column: str = "date") -> DataFrame:
    """Add the missing days between the first and the last, with NULL values.

    Each day is followed by the days up to the next one present, so nothing has
    to be joined or read twice. Days are few (the date type itself ends at 3.7
    million), whatever the number of readings behind them.
    """
    following = F.lead(date_column).over(Window.orderBy(date_column))
    until = F.coalesce(F.date_sub(following, 1), F.col(date_column))
    return days.withColumn("__until", until).select(
        F.explode(F.sequence(F.col(date_column), F.col("__until"), F.expr("interval 1 day"))).alias("__day"),
        *days.columns,
    ).select(
        F.col("__day").alias(date_column),
        *[F.when(F.col("__day") == F.col(date_column), F.col(c)).alias(c) for c in columns],
    )


def daily_means_calendar(
    df: DataFrame,
    columns: Sequence[str],
    timestamp_column: str = "timestamp",
    resolution: int | None = None,
) -> DataFrame:
    """Daily means of several columns on the full calendar.

    Every day from the first to the last reading has a row; a day without values
    has NULL.
    """
    daily = (
        df.where(F.col(timestamp_column).isNotNull())
        .groupBy(F.to_date(timestamp_column).alias("date"))
        .agg(*[steady_mean(c, resolution).alias(c) for c in columns])
    )
    return fill_calendar(daily, columns)


def daily_mean_calendar(
    df: DataFrame,
    column: str,
    timestamp_column: str = "timestamp",
    resolution: int | None = None,
) -> DataFrame:
    """Daily mean of one column on the full calendar as ``(date, value)``."""
    return daily_means_calendar(df, [column], timestamp_column, resolution).withColumnRenamed(
        column, "value"
    )


def month_over_month(
    df: DataFrame,
    column: str,
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Monthly mean, the previous calendar month's mean, and the change.

    Means are rounded before they are subtracted, as in the published figures;
    ``digits=None`` keeps full precision. A month whose predecessor is absent
    has no change. The window runs over months, never over readings.
    """
    year, month = F.col(year_column), F.col(month_column)
    index = month_index(year, month)
    months = df.groupBy(year_column, month_column).agg(
        rounded(steady_mean(column, resolution), digits).alias("mean")
    )
    in_order = Window.orderBy(index)
    follows = F.lag(index).over(in_order) == index - 1
    previous = F.when(follows, F.lag("mean").over(in_order))
    return (
        months.withColumn("previous_mean", previous)
        .withColumn("change", rounded(F.col("mean") - F.col("previous_mean"), digits))
        .orderBy(year_column, month_column)
    )


def month_shape(
    df: DataFrame,
    columns: Sequence[str],
    month_column: str = "month",
    resolution: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Mean per month of the year, scaled to 0..1 per column.

    A column with the same mean in all months has no shape: NULL.
    """
    months = df.groupBy(month_column).agg(
        *[steady_mean(c, resolution).alias(c) for c in columns]
    )
    every = Window.partitionBy()
    shape = {
        c: rounded(
            ratio(
                F.col(c) - F.min(c).over(every),
                F.max(c).over(every) - F.min(c).over(every),
            ),
            digits,
        )
        for c in columns
    }
    return months.withColumns(shape).orderBy(month_column)
