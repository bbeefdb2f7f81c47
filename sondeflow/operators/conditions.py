"""Condition classes and threshold reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (
    band,
    mean_of,
    mean_of_parts,
    one_row_per_column,
    ratio,
    rounded,
    steady_mean,
    steady_total,
    step_parts,
)
from .filters import inside
from .intervals import covering, sums_inside


def band_counts(
    df: DataFrame,
    column: str,
    bands: Sequence[tuple[float | None, str]],
    name: str = "band",
) -> DataFrame:
    """Readings per band, most frequent first; missing values are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(band(column, bands).alias(name))
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .orderBy(F.col("reading_count").desc(), name)
    )


def band_counts_by(
    df: DataFrame,
    by: str,
    column: str,
    bands: Sequence[tuple[float | None, str]],
    name: str = "band",
) -> DataFrame:
    """Readings per group and band, groups in order, most frequent band first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(by, band(column, bands).alias(name))
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .orderBy(by, F.col("reading_count").desc(), name)
    )


def readings_above_by_month(
    df: DataFrame,
    column: str,
    threshold: float,
    year_column: str = "year",
    month_column: str = "month",
    name: str = "high_readings",
) -> DataFrame:
    """Readings above a threshold per month; months without any are absent."""
    return (
        df.where(F.col(column) > threshold)
        .groupBy(year_column, month_column)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(year_column, month_column)
    )


def hours_summary_by(
    df: DataFrame,
    by: str,
    column: str,
    first_hour: int = 6,
    before_hour: int = 18,
    hour_column: str = "hour",
    digits: int | None = 3,
    resolution: int | None = None,
) -> DataFrame:
    """Count, mean, minimum and maximum within some hours, highest mean first."""
    kept = df.where(
        (F.col(hour_column) >= first_hour)
        & (F.col(hour_column) < before_hour)
        & F.col(column).isNotNull()
    )
    return (
        kept.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("reading_count"),
            rounded(steady_mean(column, resolution), digits).alias("mean"),
            rounded(F.min(column), digits).alias("min"),
            rounded(F.max(column), digits).alias("max"),
        )
        .orderBy(F.col("mean").desc(), by)
    )


def months_above_overall_mean(
    df: DataFrame,
    column: str,
    factor: float = 2.0,
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Months whose mean exceeds ``factor`` times the mean of all readings.

    The overall mean follows from the months' totals, so readings are read once;
    the window runs over months.
    """
    every = Window.partitionBy()
    months = (
        df.where(F.col(column).isNotNull())
        .groupBy(year_column, month_column)
        .agg(steady_total(column, resolution).alias("total"), F.count(column).alias("n"))
    )
    overall = mean_of(F.sum("total").over(every), F.sum("n").over(every), resolution)
    return (
        months.withColumn("mean", mean_of(F.col("total"), F.col("n"), resolution))
        .withColumn("overall", overall)
        .where(F.col("mean") > F.col("overall") * factor)
        .select(year_column, month_column, rounded(F.col("mean"), digits).alias("mean"))
        .orderBy(F.col("mean").desc(), year_column, month_column)
    )


def low_days(
    df: DataFrame,
    column: str,
    below: float,
    min_readings: int,
    day_columns: Sequence[str] = ("year", "month", "day"),
    digits: int | None = 2,
    resolution: int | None = None,
) -> DataFrame:
    """Days with enough readings and a mean below a limit, lowest first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*day_columns)
        .agg(F.count(F.lit(1)).alias("reading_count"), steady_mean(column, resolution).alias("mean"))
        .where((F.col("reading_count") >= min_readings) & (F.col("mean") < below))
        .withColumn("mean", rounded(F.col("mean"), digits))
        .orderBy("mean", *day_columns)
    )


def atypical_share(
    df: DataFrame,
    by: str,
    column: str,
    low: float,
    high: float,
    digits: int | None = 2,
) -> DataFrame:
    """Readings outside a typical range per group: total, count and percent."""
    outside = (F.col(column) < low) | (F.col(column) > high)
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            F.count_if(outside).alias("atypical_readings"),
        )
        .withColumn(
            "atypical_pct",
            rounded(ratio(F.lit(100.0) * F.col("atypical_readings"), F.col("total_readings")), digits),
        )
        .orderBy(F.col("atypical_pct").desc(), by)
    )


def event_means(
    df: DataFrame,
    columns: Sequence[str],
    start: str,
    end: str,
    whole_days: bool = False,
    timestamp_column: str = "timestamp",
    digits: int | None = None,
    resolution: int | None = None,
) -> DataFrame:
    """Overall mean of each column next to its mean inside an event window."""
    within: Column = inside(F.col(timestamp_column), start, end, whole_days)
    wide = df.agg(
        *[steady_mean(c, resolution).alias(f"{c}_all") for c in columns],
        *[steady_mean(F.when(within, F.col(c)), resolution).alias(f"{c}_event") for c in columns],
    )
    return one_row_per_column(wide, "parameter", {
        c: {
            "event_mean": rounded(F.col(f"{c}_event"), digits),
            "overall_mean": rounded(F.col(f"{c}_all"), digits),
        }
        for c in columns
    })


def event_table_means(
    df: DataFrame,
    columns: Sequence[str],
    events: DataFrame,
    key: str = "event",
    timestamp_column: str = "timestamp",
    digits: int | None = None,
    resolution: int | None = None,
) -> DataFrame:
    """``(key, start, end, readings, <column>_mean ...)`` for each event of a table.

    ``events`` has ``key``, which tells them apart, ``start`` and ``end``. Events may
    overlap; one without readings has none, and no mean. With a ``resolution`` the work grows
    with the rows of both tables; without one it grows with their pairs.
    """
    intervals = events.select(F.col(key).alias("__event"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    if resolution is None:
        # sums of doubles can not be subtracted without loss
        means = covering(df.select(timestamp_column, *columns), timestamp_column, intervals, "__start", "__end")
        means = means.groupBy("__event").agg(
            F.count(F.lit(1)).alias("readings"),
            *[rounded(steady_mean(c), digits).alias(f"{c}_mean") for c in columns],
        )
    else:
        parts = {c: step_parts(c, resolution) for c in columns}
        whole = {"readings": F.lit(1).cast("bigint")} | {f"{c}_{p}": v for c in columns for p, v in parts[c].items()}
        moments = df.select(F.col(timestamp_column).alias("__moment"), *[v.alias(name) for name, v in whole.items()])
        sums = sums_inside(moments, "__moment", list(whole), intervals, "__event", "__start", "__end")
        means = sums.select("__event", F.col("readings").cast("bigint").alias("readings"), *[
            rounded(mean_of_parts({p: F.col(f"{c}_{p}") for p in parts[c]}, resolution), digits).alias(f"{c}_mean")
            for c in columns
        ])
    return events.select(key, "start", "end").join(means, F.col(key) == F.col("__event"), "left").select(
        key, "start", "end", F.coalesce("readings", F.lit(0).cast("bigint")).alias("readings"),
        *[f"{c}_mean" for c in columns],
    )
