"""Column expressions shared by the operators."""

from .bands import band
from .calendar import (
    as_category,
    month_index,
    ordinal,
    period,
    season_of,
    weekday_name,
)
from .numeric import (
    mean_of,
    mean_of_parts,
    missing_share,
    nan_to_null,
    ratio,
    rounded,
    steady_mean,
    steady_total,
    step_parts,
)
from .reshape import one_row_per_column

__all__ = [
    "as_category", "band", "mean_of", "mean_of_parts", "missing_share", "month_index", "nan_to_null",
    "one_row_per_column", "ordinal", "period", "ratio", "rounded", "season_of",
    "steady_mean", "steady_total", "step_parts", "weekday_name",
]
