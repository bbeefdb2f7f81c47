"""The calendar and band expressions as functions that SQL can call.

Their bodies are SQL made from the same lists as the column expressions, so the
planner inlines them: no function is called per row. Spark takes them in a select list or
a filter; to sort by one, select it under a name first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..schema import OXYGEN_BANDS, SALINITY_BANDS, SEASONS, WEEKDAYS

Bands = Sequence[tuple[float | None, str]]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(names: Sequence[str]) -> str:
    return f"array({', '.join(map(_quoted, names))})"


def band_body(value: str, bands: Bands) -> str:
    """SQL for the label of the first band whose upper bound lies above ``value``."""
    *bounded, (last_bound, last_label) = bands
    if last_bound is not None:
        raise ValueError("the last band takes everything else; its bound must be None")
    cases = " ".join(f"WHEN {value} < {float(bound)!r}D THEN {_quoted(label)}" for bound, label in bounded)
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE {_quoted(last_label)} END"


def _create(spark: SparkSession, name: str, parameter: str, returns: str, body: str, temporary: bool) -> None:
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(f"CREATE OR REPLACE {kind} {name}({parameter}) RETURNS {returns} RETURN {body}")


def create_band_function(spark: SparkSession, name: str, bands: Bands, temporary: bool = True) -> None:
    """Make ``name(value DOUBLE)`` return the label of the value's band."""
    _create(spark, name, "value DOUBLE", "STRING", band_body("value", bands), temporary)


def register_functions(spark: SparkSession, southern: bool = True, temporary: bool = True) -> None:
    """Make the functions of a water-quality table known to SQL.

    ``season_of(month)``, ``season_position(season)``, ``weekday_position(day)``,
    ``oxygen_band(value)`` and ``salinity_class(value)``. Temporary ones end with the session;
    others stay in the current database of a catalog that keeps functions.
    """
    seasons = SEASONS if southern else [*SEASONS[2:], *SEASONS[:2]]
    season = f"get({_listed(seasons)}, CAST(floor((month % 12) / 3) AS INT))"
    _create(spark, "season_of", "month INT", "STRING", season, temporary)
    for name, values in (("season_position", SEASONS), ("weekday_position", WEEKDAYS)):
        body = f"nullif(array_position({_listed(values)}, value), 0)"
        _create(spark, name, "value STRING", "BIGINT", body, temporary)
    create_band_function(spark, "oxygen_band", OXYGEN_BANDS, temporary)
    create_band_function(spark, "salinity_class", SALINITY_BANDS, temporary)
