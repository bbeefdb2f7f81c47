"""The standing reports over a cleaned ``water_quality`` table.

Each report is an operator bound to the table's own columns and to the limits in
use. Call one with any frame that has the cleaned columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import (
    anomaly,
    conditions,
    duplicates,
    missingness,
    overview,
    quality,
    temporal,
    windows,
)
from ..schema import MEASURES, OXYGEN_BANDS, PHYSICAL_RULES, SALINITY_BANDS

Report = Callable[[DataFrame], DataFrame]

_BY_CHECK = {rule.check: rule for rule in PHYSICAL_RULES}


def _broken(check: str, name: str) -> Report:
    return lambda df: quality.implausible_rows(df, [_BY_CHECK[check]], name)


def _named(df: DataFrame, **names: str) -> DataFrame:
    """Rename result columns to the names readers of the report know."""
    return df.withColumnsRenamed(names)


def _daily_turbidity(df: DataFrame) -> DataFrame:
    return temporal.daily_mean(df, "turbidity")


REPORTS: dict[str, Report] = {
    # data quality
    "total_rows": overview.row_count,
    "seasons": lambda df: overview.distinct_values(df, "season"),
    "weekdays": lambda df: overview.distinct_values(df, "day_of_week"),
    "months": lambda df: overview.distinct_values(df, "year", "month"),
    "null_counts": lambda df: missingness.null_counts(
        df, MEASURES, {"dissolved_oxygen_pct_sat": "null_do_pct_sat"}
    ),
    "missing_percent": lambda df: missingness.missingness_summary(df, MEASURES).select(
        "parameter", "missing_pct"
    ),
    "repeated_record_numbers": lambda df: duplicates.repeated_keys(df, "record_number"),
    "repeated_timestamps": lambda df: duplicates.top_repeated(df, "timestamp", 10),
    "invalid_ph": _broken("invalid_ph", "invalid_ph_rows"),
    "invalid_direction": _broken("invalid_water_direction", "invalid_direction_rows"),
    "implausible_saturation": _broken(
        "implausible_do_saturation", "implausible_do_saturation_rows"
    ),
    "negative_values": _broken("negative_values", "negative_value_rows"),
    "empty_rows": lambda df: missingness.all_missing_rows(df, MEASURES),
    # time
    "monthly_coverage": temporal.monthly_coverage,
    "monthly_conditions": lambda df: _named(
        temporal.monthly_summary(df, ["temperature", "dissolved_oxygen", "turbidity"]),
        **{
            f"{c}_{kind}": f"{short}_{c}"
            for c in ("temperature", "dissolved_oxygen", "turbidity")
            for kind, short in (("mean", "avg"), ("min", "min"), ("max", "max"))
        },
    ),
    "seasonal_conditions": lambda df: _named(
        temporal.seasonal_summary(
            df,
            ["temperature", "dissolved_oxygen", "dissolved_oxygen_pct_sat", "salinity",
             "turbidity", "ph"],
        ),
        temperature_mean="avg_temperature",
        dissolved_oxygen_mean="avg_dissolved_oxygen",
        dissolved_oxygen_pct_sat_mean="avg_do_pct_sat",
        salinity_mean="avg_salinity",
        turbidity_mean="avg_turbidity",
        ph_mean="avg_ph",
    ),
    "weekday_conditions": lambda df: _named(
        temporal.weekday_summary(df, ["turbidity", "dissolved_oxygen"]),
        turbidity_mean="avg_turbidity",
        dissolved_oxygen_mean="avg_dissolved_oxygen",
    ),
    "hourly_conditions": lambda df: _named(
        temporal.hourly_cycle(df, ["temperature", "dissolved_oxygen_pct_sat"]),
        temperature_mean="avg_temperature",
        dissolved_oxygen_pct_sat_mean="avg_do_pct_sat",
    ),
    "temperature_change": lambda df: _named(
        temporal.month_over_month(df, "temperature"),
        mean="avg_temperature",
        previous_mean="prev_month_avg_temperature",
        change="change_from_prev_month",
    ),
    "monitoring_period": lambda df: overview.extent(df).select("first_reading", "last_reading"),
    # water quality
    "oxygen_bands": lambda df: conditions.band_counts(
        df, "dissolved_oxygen", OXYGEN_BANDS, "oxygen_band"
    ),
    "high_turbidity_months": lambda df: conditions.readings_above_by_month(
        df, "turbidity", 20, name="high_turbidity_readings"
    ),
    "daytime_ph": lambda df: _named(
        conditions.hours_summary_by(df, "season", "ph", 6, 18),
        mean="avg_ph", min="min_ph", max="max_ph",
    ),
    "turbid_months": lambda df: _named(
        conditions.months_above_overall_mean(df, "turbidity", 2.0), mean="avg_turbidity"
    ),
    "salinity_classes": lambda df: conditions.band_counts_by(
        df, "season", "salinity", SALINITY_BANDS, "salinity_class"
    ),
    "low_oxygen_days": lambda df: _named(
        conditions.low_days(df, "dissolved_oxygen", 6, 40), mean="avg_dissolved_oxygen"
    ),
    "atypical_temperatures": lambda df: _named(
        conditions.atypical_share(df, "season", "temperature", 15, 30),
        atypical_readings="atypical_temp_readings",
        atypical_pct="atypical_temp_pct",
    ),
    # environmental insights
    "rolling_turbidity": lambda df: _named(
        windows.rolling_mean(temporal.daily_mean(df, "turbidity", digits=2)),
        date="reading_date", value="avg_turbidity", rolling_mean="rolling_7day_avg_turbidity",
    ),
    "turbidity_anomalies": lambda df: _named(
        anomaly.high_days(_daily_turbidity(df)),
        date="reading_date", value="avg_turbidity", overall_mean="dataset_mean_turbidity",
    ),
    "turbidity_ranks": lambda df: _named(
        windows.rank_months(df, "turbidity"), mean="avg_turbidity", rank="turbidity_rank"
    ),
    "turbidity_deviations": lambda df: _named(
        windows.largest_deviations(df, "turbidity", 15).drop("record_number"),
        day_mean="day_avg_turbidity", deviation="deviation_from_day_avg",
    ),
    "cumulative_oxygen": lambda df: _named(
        windows.cumulative_mean(temporal.daily_mean(df, "dissolved_oxygen")),
        date="reading_date", value="avg_do", cumulative_mean="cumulative_avg_do",
    ),
    "turbidity_streaks": lambda df: _named(
        anomaly.high_streaks(_daily_turbidity(df), 10), streak_mean="streak_avg_turbidity"
    ),
}


def run_report(df: DataFrame, name: str) -> DataFrame:
    """One report by name."""
    return REPORTS[name](df)
