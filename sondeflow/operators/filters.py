"""Row filters and event windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import month_index
from .intervals import covering

Window = tuple[str, str, str]


def selected(seasons: Sequence[str], column: str = "season") -> Column:
    """Whether a row's season is selected; an empty selection selects nothing."""
    return F.col(column).isin(list(seasons))


def in_seasons(df: DataFrame, seasons: Sequence[str], column: str = "season") -> DataFrame:
    """Keep the selected seasons; an empty selection keeps nothing."""
    return df.where(selected(seasons, column))


def with_values(df: DataFrame, column: str) -> DataFrame:
    """Drop the rows where one column is missing."""
    return df.where(F.col(column).isNotNull())


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Keep the readings above a threshold; missing values never pass."""
    return df.where(F.col(column) > threshold)


def between_hours(df: DataFrame, first: int, before: int, column: str = "hour") -> DataFrame:
    """Keep the hours ``first <= hour < before``."""
    return df.where((F.col(column) >= first) & (F.col(column) < before))


def inside(moment: Column, start: str, end: str, whole_days: bool = False) -> Column:
    """Whether a time lies in a closed window.

    An end at midnight takes in only that instant of the last day, unless
    ``whole_days`` extends the window to the end of that day.
    """
    low = F.lit(datetime.fromisoformat(start)).cast("timestamp_ntz")
    high = F.lit(datetime.fromisoformat(end)).cast("timestamp_ntz")
    if whole_days:
        last = F.date_add(F.to_date(high), 1).cast("timestamp_ntz")
        return (moment >= F.to_date(low).cast("timestamp_ntz")) & (moment < last)
    return moment.between(low, high)


def between_times(
    df: DataFrame,
    start: str,
    end: str,
    whole_days: bool = False,
    timestamp_column: str = "timestamp",
    year_column: str | None = None,
    month_column: str | None = None,
) -> DataFrame:
    """Keep the readings of a closed time window.

    Name the year and month columns when the table is partitioned by them: a
    time predicate alone does not prune those folders.
    """
    df = df.where(inside(F.col(timestamp_column), start, end, whole_days))
    if year_column and month_column:
        low, high = datetime.fromisoformat(start), datetime.fromisoformat(end)
        df = df.where(
            month_index(F.col(year_column), F.col(month_column)).between(
                low.year * 12 + low.month, high.year * 12 + high.month
            )
        )
    return df


def event_windows(spark: SparkSession, windows: Sequence[Window]) -> DataFrame:
    """The listed ``(start, end, label)`` windows as a table of days."""
    rows = [
        F.struct(
            F.lit(start).cast("timestamp_ntz").alias("start"),
            F.lit(end).cast("timestamp_ntz").alias("end"),
            F.lit(label).alias("event_label"),
        )
        for start, end, label in windows
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def annotate_events(
    days: DataFrame, windows: Sequence[Window] | DataFrame, date_column: str = "date"
) -> DataFrame:
    """Add the label of the event window that covers each day, if any.

    A day inside several windows appears once for each of them. A listed window table
    has exactly the listed rows, so it is broadcast. A table ``(start, end,
    event_label)`` of any size is joined by bins of time.
    """
    if isinstance(windows, DataFrame):
        whole = windows.select(
            F.to_date("start").alias("start"), F.to_date("end").alias("end"), "event_label"
        )
        return covering(days, date_column, whole, how="left").drop("start", "end")
    events = event_windows(days.sparkSession, windows)
    covers = F.col(date_column).between(F.to_date("start"), F.to_date("end"))
    return days.join(F.broadcast(events), covers, "left").drop("start", "end")
