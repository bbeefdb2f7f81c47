"""Cleaning: names, types and time features. No operator here drops a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import nan_to_null, season_of, weekday_name
from ..schema import MEASURES, QUALITY_FLAGS, RAW_TO_CLEAN

_CALENDAR_PARTS = ("year", "month", "day", "hour")


def rename_columns(df: DataFrame, names: Mapping[str, str] = RAW_TO_CLEAN) -> DataFrame:
    """Rename raw headers; absent ones are skipped, unknown columns stay."""
    return df.withColumnsRenamed(dict(names))


def convert_timestamp(
    df: DataFrame, column: str = "timestamp", malformed: str = "raise"
) -> DataFrame:
    """Text to timestamp. Malformed text raises, or becomes NULL on request."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    parse = {"raise": F.to_timestamp, "null": F.try_to_timestamp}[malformed]
    return df.withColumn(column, parse(F.col(column)))


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floating = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def typed(df: DataFrame, malformed: str = "raise") -> DataFrame:
    """Give the known columns their types; text in other columns stays text."""
    wanted = {"record_number": "bigint"}
    wanted.update({c: "double" for c in [*MEASURES, *QUALITY_FLAGS]})
    wanted.update({c: "int" for c in _CALENDAR_PARTS})
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cast = (lambda c, t: c.try_cast(t)) if malformed == "null" else (lambda c, t: c.cast(t))
    casts = {c: cast(F.col(c), t) for c, t in wanted.items() if c in text}
    df = df.withColumns(casts) if casts else df
    if "timestamp" in df.columns:
        df = convert_timestamp(df, malformed=malformed)
    return nulls_for_nan(df)


def add_time_features(
    df: DataFrame, timestamp_column: str = "timestamp", southern: bool = True
) -> DataFrame:
    """Add year, month, day, hour, day_of_week and season of the reading time."""
    df = convert_timestamp(df, timestamp_column)
    moment = F.col(timestamp_column)
    return df.withColumns({
        "year": F.year(moment),
        "month": F.month(moment),
        "day": F.dayofmonth(moment),
        "hour": F.hour(moment),
        "day_of_week": weekday_name(moment),
        "season": season_of(F.month(moment), southern),
    })


def clean(raw: DataFrame, southern: bool = True, malformed: str = "raise") -> DataFrame:
    """Raw readings to cleaned readings: one narrow stage, no shuffle."""
    return add_time_features(typed(rename_columns(raw), malformed), southern=southern)


def chronological(
    df: DataFrame, timestamp_column: str = "timestamp", key: str = "record_number"
) -> DataFrame:
    """Sort by time, ties by record number."""
    return df.orderBy(timestamp_column, key)


def present_measures(df: DataFrame, measures: Sequence[str] = MEASURES) -> list[str]:
    """The measures this frame has, in table order."""
    return [c for c in measures if c in df.columns]


def select_measures(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Project to the measures this frame has."""
    return df.select(*present_measures(df, measures))
