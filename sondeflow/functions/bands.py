"""Banding of a measure into labelled condition classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def band(column: str | Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose upper bound lies above the value.

    ``bands`` lists ``(upper_bound, label)`` from low to high and ends with
    ``(None, label)`` for the rest. A missing value has no band.
    """
    value = F.col(column) if isinstance(column, str) else column
    *bounded, (last_bound, last_label) = bands
    if last_bound is not None:
        raise ValueError("the last band takes everything else; its bound must be None")
    label = F.when(value.isNull(), F.lit(None))
    for bound, name in bounded:
        label = label.when(value < bound, F.lit(name))
    return label.otherwise(F.lit(last_label))
