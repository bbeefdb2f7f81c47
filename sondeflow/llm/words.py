"""Column expressions on the words of a text, from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A word is a run of characters outside space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str) -> Column:
    """The text, empty if missing."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str) -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def word_list(column: str) -> Column:
    return F.regexp_extract_all(whole_text(column), F.lit(WORD), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
