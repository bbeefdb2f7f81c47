"""Calendar expressions: seasons, weekdays, periods and category orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..schema import SEASONS, WEEKDAYS


def season_of(month: Column, southern: bool = True) -> Column:
    """Meteorological season of a month number, NULL for a NULL month.

    Quarters start in December: the southern year opens with summer there, the
    northern one with winter, half the cycle later.
    """
    shift = 0 if southern else 2
    names = F.array(*[F.lit(SEASONS[(i + shift) % 4]) for i in range(4)])
    quarter = F.floor((month % 12) / 3).cast("int")
    # Not element_at: under ANSI rules that takes a NULL position for a value.
    return F.get(names, quarter)


def weekday_name(moment: Column) -> Column:
    """Full English day name. A lookup, so no formatter runs per row."""
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(moment))


def ordinal(column: str | Column, categories: Sequence[str]) -> Column:
    """Position of a value in an ordered category list, NULL when not listed."""
    column = F.col(column) if isinstance(column, str) else column
    listed = F.array(*[F.lit(c) for c in categories])
    return F.nullif(F.array_position(listed, column), F.lit(0))


def as_category(column: str | Column, categories: Sequence[str]) -> Column:
    """The value when it is one of the categories, otherwise NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isin(list(categories)), column)


def period(year: Column, month: Column) -> Column:
    """First day of a calendar month."""
    return F.make_date(year, month, F.lit(1))


def month_index(year: Column, month: Column) -> Column:
    """Months since year zero; neighbouring calendar months differ by one."""
    return year * 12 + month
