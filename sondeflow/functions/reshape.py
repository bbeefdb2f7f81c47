"""Turning a wide aggregate into one row per measured column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def one_row_per_column(
    wide: DataFrame,
    name: str,
    rows: Mapping[str, Mapping[str, Column]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Unfold each row of ``wide`` into one row per entry of ``rows``.

    Aggregating all columns in one wide row and unfolding the result reads the
    input once and shuffles one row per task; unfolding the input first would
    multiply every reading by the number of columns.
    """
    structs = [
        F.struct(F.lit(label).alias(name), *[c.alias(field) for field, c in fields.items()])
        for label, fields in rows.items()
    ]
    return wide.select(*keep, F.inline(F.array(*structs)))
