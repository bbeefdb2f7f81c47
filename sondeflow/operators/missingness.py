"""How much is missing, in total and over time. One scan per report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import missing_share, one_row_per_column, period, rounded


def null_counts(
    df: DataFrame, columns: Sequence[str], names: Mapping[str, str] | None = None
) -> DataFrame:
    """Total rows and the NULLs of each column, in one wide row."""
    names = names or {}
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(names.get(c, f"null_{c}")) for c in columns],
    )


def missingness_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    digits: int | None = 2,
    min_count: int = 0,
) -> DataFrame:
    """Missing values of each column as count and percent, worst first."""
    columns = list(columns if columns is not None else df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    summary = one_row_per_column(wide, "parameter", {
        c: {
            "missing_count": F.col(f"n{i}"),
            "missing_pct": rounded(
                F.try_divide(F.lit(100.0) * F.col(f"n{i}"), F.col("__rows")), digits
            ),
        }
        for i, c in enumerate(columns)
    })
    return summary.where(F.col("missing_count") >= min_count).orderBy(
        F.col("missing_pct").desc(), "parameter"
    )


def missing_pct_by(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int | None = 1
) -> DataFrame:
    """Missing percent of each column per group, in group order."""
    return (
        df.groupBy(*by)
        .agg(*[rounded(missing_share(c), digits).alias(c) for c in columns])
        .orderBy(*by)
    )


def missing_pct_by_month(
    df: DataFrame,
    column: str,
    year_column: str = "year",
    month_column: str = "month",
    digits: int | None = None,
) -> DataFrame:
    """Missing percent of one column per calendar month, with the period's date."""
    return (
        df.groupBy(year_column, month_column)
        .agg(rounded(missing_share(column), digits).alias("missing_pct"))
        .withColumn("period", period(F.col(year_column), F.col(month_column)))
        .orderBy("period")
    )


def missing_pct(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """Missing percent of one column; NULL when there are no rows."""
    return df.agg(rounded(missing_share(column), digits).alias("missing_pct"))


def all_missing_rows(
    df: DataFrame, columns: Sequence[str], name: str = "fully_empty_measurement_rows"
) -> DataFrame:
    """Number of rows without a single measured value."""
    return df.agg(F.count_if(F.coalesce(*columns).isNull()).alias(name))
