"""Duplicate rows, keys and timestamps.

Grouping pre-aggregates in every task, so a key that holds much of the table
costs one partial count per task. Nothing here windows over a raw key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..scale import attach

#: Copies written back by one task for one duplicated row.
_COPIES_PER_CHUNK = 100_000


def full_duplicates(df: DataFrame) -> DataFrame:
    """All copies of the rows that occur more than once.

    Copies are identical, so they are written back from their count; the table
    is shuffled once and joined with nothing. A row with very many copies is cut
    into chunks that are spread over the tasks.
    """
    columns = df.columns
    repeated = (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
        .where(F.col("__copies") > 1)
    )
    last_chunk = F.floor((F.col("__copies") - 1) / _COPIES_PER_CHUNK)
    chunks = repeated.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    size = F.least(
        F.lit(_COPIES_PER_CHUNK),
        F.col("__copies") - F.col("__chunk") * _COPIES_PER_CHUNK,
    )
    return (
        chunks.withColumn("__size", size)
        .repartition("__chunk", *columns)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__size")))
        .select(*columns)
    )


def excess_rows(df: DataFrame, columns: Sequence[str] | None = None, name: str = "excess_rows") -> DataFrame:
    """Copies beyond the first, of whole rows or of some columns.

    NULL counts as one ordinary value.
    """
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias(name))


def repeated_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their number of occurrences."""
    return (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def duplicate_key_rows(df: DataFrame, *columns: str) -> DataFrame:
    """All rows whose key occurs more than once. A NULL key is never reported.

    Nothing runs while the frame is built. The repeated keys are a partial aggregate;
    adaptive execution broadcasts them if they turn out small, and otherwise
    splits the tasks of a key that holds much of the table.
    """
    return attach(df, repeated_keys(df, *columns), list(columns), "left_semi")


def top_repeated(df: DataFrame, column: str = "timestamp", k: int = 10) -> DataFrame:
    """The ``k`` most repeated values of a column."""
    return repeated_keys(df, column).orderBy(F.col("occurrences").desc(), column).limit(k)


def rows_sharing(
    df: DataFrame,
    column: str = "timestamp",
    show: Sequence[str] | None = None,
    order: Sequence[str] = ("timestamp", "record_number"),
    k: int | None = 10,
) -> DataFrame:
    """Rows that share a value with another row, the first ``k`` in order.

    When the shared value comes first in the order, ``k`` rows lie within the first
    ``k`` repeated values, and only those are looked up.
    """
    wanted = list(dict.fromkeys([*(show or df.columns), *order]))
    rows = df.select(*wanted)
    if k is not None and order and order[0] == column:
        first = repeated_keys(rows, column).where(F.col(column).isNotNull()).orderBy(column).limit(k)
        rows = attach(rows, first, [column], "left_semi", broadcast=True)
    else:
        rows = duplicate_key_rows(rows, column)
    rows = rows.orderBy(*order)
    rows = rows if k is None else rows.limit(k)
    return rows.select(*(show or df.columns))
