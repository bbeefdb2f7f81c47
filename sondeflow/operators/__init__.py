"""Operators: functions from DataFrame to DataFrame."""

from . import (
    anomaly,
    cleaning,
    comoments,
    conditions,
    duplicates,
    filters,
    gaps,
    intervals,
    missingness,
    overview,
    quality,
    quantiles,
    rollup,
    series,
    stats,
    temporal,
    windows,
)

__all__ = [
    "anomaly", "cleaning", "comoments", "conditions", "duplicates", "filters", "gaps",
    "intervals", "missingness", "overview", "quality", "quantiles", "rollup", "series", "stats", "temporal", "windows",
]
