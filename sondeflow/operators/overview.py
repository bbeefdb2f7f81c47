"""First looks at a table: rows, types, extent, distinct categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import one_row_per_column


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def filtered_row_count(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition next to all rows."""
    return df.agg(
        F.count_if(condition).alias("filtered_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def first_rows(df: DataFrame, n: int = 5, order: Sequence[str] = ("timestamp", "record_number")) -> DataFrame:
    """The earliest rows. Files have no order on a cluster; time has one."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, n: int = 5, order: Sequence[str] = ("timestamp", "record_number")) -> DataFrame:
    """The latest rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def table_overview(df: DataFrame) -> DataFrame:
    """Position, type, rows and non-missing values of every column, in one scan."""
    types = dict(df.dtypes)
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    return one_row_per_column(wide, "column", {
        c: {
            "position": F.lit(i + 1),
            "dtype": F.lit(types[c]),
            "total_rows": F.col("__rows"),
            "non_null": F.col(f"n{i}"),
        }
        for i, c in enumerate(df.columns)
    })


def extent(df: DataFrame, timestamp_column: str = "timestamp") -> DataFrame:
    """First and last reading and the time between them in seconds."""
    first, last = F.min(timestamp_column), F.max(timestamp_column)
    seconds = (
        F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    ) / F.lit(1e6)
    return df.agg(
        first.alias("first_reading"),
        last.alias("last_reading"),
        seconds.alias("span_seconds"),
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations of some columns, in order."""
    return df.select(*columns).distinct().orderBy(*columns)
