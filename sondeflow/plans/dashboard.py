"""The tables behind an interactive page: one filter, four views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.cleaning import present_measures
from ..operators.filters import Window, annotate_events, in_seasons, selected
from ..operators.missingness import missing_pct
from ..operators.overview import filtered_row_count
from ..operators.stats import box_stats, correlation_matrix
from ..operators.temporal import daily_mean_calendar, hourly_cycle
from ..schema import EVENT_WINDOWS, MEASURES, SEASONS


def dashboard_frames(
    df: DataFrame,
    parameter: str,
    seasons: Sequence[str] = SEASONS,
    windows: Sequence[Window] = EVENT_WINDOWS,
    measures: Sequence[str] = MEASURES,
) -> dict[str, DataFrame]:
    """Headline numbers, daily trend, seasonal boxes, hour pattern, correlation."""
    kept = in_seasons(df, seasons)
    return {
        "rows": filtered_row_count(df, selected(seasons)),
        "missing": missing_pct(kept, parameter, digits=1),
        "daily_trend": annotate_events(daily_mean_calendar(kept, parameter), windows).orderBy("date"),
        "season_boxes": box_stats(kept, [parameter], by=["season"]),
        "hour_pattern": hourly_cycle(kept, [parameter], digits=None),
        "correlation": correlation_matrix(kept, present_measures(kept, measures)),
    }
