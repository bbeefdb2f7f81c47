"""The standing reports against plain SQL over the same table."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import cleaning
from sondeflow.plans import REPORTS, dashboard_frames, run_report
from sondeflow.schema import MEASURES

from frames import START, raw_frame, rows, to_spark
from oracle import answers

import duckdb

SQL = {
    "seasons": "SELECT DISTINCT season FROM t",
    "weekdays": "SELECT DISTINCT day_of_week FROM t",
    "invalid_ph": "SELECT count(*) AS invalid_ph_rows FROM t WHERE ph < 0 OR ph > 14",
    "invalid_direction": "SELECT count(*) AS invalid_direction_rows FROM t WHERE water_direction < 0 OR water_direction > 360",
    "implausible_saturation": "SELECT count(*) AS implausible_do_saturation_rows FROM t WHERE dissolved_oxygen_pct_sat > 200",
    "repeated_record_numbers": "SELECT record_number, count(*) AS occurrences FROM t GROUP BY 1 HAVING count(*) > 1",
    "repeated_timestamps": "SELECT timestamp, count(*) AS occurrences FROM t GROUP BY 1 HAVING count(*) > 1"
        " ORDER BY 2 DESC, 1 LIMIT 10",
    "low_oxygen_days": "SELECT year, month, day, count(dissolved_oxygen) AS reading_count,"
        " round(CAST(avg(dissolved_oxygen) AS DECIMAL(20,8)), 2)::DOUBLE AS avg_dissolved_oxygen FROM t"
        " GROUP BY ALL HAVING count(dissolved_oxygen) >= 40 AND avg(dissolved_oxygen) < 6",
    "total_rows": "SELECT count(*) AS total_rows FROM t",
    "months": "SELECT DISTINCT year, month FROM t",
    "missing_percent": " UNION ALL ".join(
        f"SELECT '{m}' AS parameter, round(CAST(100.0 * (count(*) - count({m})) / count(*) AS DECIMAL(20,8)), 2)::DOUBLE AS missing_pct FROM t"
        for m in MEASURES
    ),
    "empty_rows": "SELECT count(*) AS fully_empty_measurement_rows FROM t WHERE coalesce("
        + ", ".join(MEASURES) + ") IS NULL",
    "negative_values": "SELECT count(*) AS negative_value_rows FROM t WHERE least(water_speed, chlorophyll,"
        " dissolved_oxygen, salinity, specific_conductance, turbidity) < 0",
    "monitoring_period": "SELECT min(timestamp) AS first_reading, max(timestamp) AS last_reading FROM t",
    "oxygen_bands": "SELECT CASE WHEN dissolved_oxygen < 4 THEN 'Low (< 4 mg/L)' WHEN dissolved_oxygen < 6"
        " THEN 'Moderate (4-6 mg/L)' WHEN dissolved_oxygen < 8 THEN 'Good (6-8 mg/L)' ELSE 'High (>= 8 mg/L)'"
        " END AS oxygen_band, count(*) AS reading_count FROM t WHERE dissolved_oxygen IS NOT NULL GROUP BY 1",
    "high_turbidity_months": "SELECT year, month, count(*) AS high_turbidity_readings FROM t WHERE turbidity > 20 GROUP BY ALL",
    "atypical_temperatures": "SELECT season, count(*) AS total_readings, count(*) FILTER (WHERE temperature < 15"
        " OR temperature > 30) AS atypical_temp_readings, round(CAST(100.0 * count(*) FILTER (WHERE temperature < 15"
        " OR temperature > 30) / count(*) AS DECIMAL(20,8)), 2)::DOUBLE AS atypical_temp_pct FROM t"
        " WHERE temperature IS NOT NULL GROUP BY season",
    "null_counts": "SELECT count(*) AS total_rows, " + ", ".join(
        f"count(*) FILTER (WHERE {m} IS NULL) AS null_{'do_pct_sat' if m == 'dissolved_oxygen_pct_sat' else m}"
        for m in MEASURES
    ) + " FROM t",
    "monthly_coverage": "SELECT year, month, count(*) AS reading_count, count(DISTINCT day)"
        " AS distinct_days_with_readings FROM t GROUP BY ALL",
    "monthly_conditions": "SELECT year, month, " + ", ".join(
        f"round({f}({m}), 2) AS {f}_{m}" for m in ("temperature", "dissolved_oxygen", "turbidity")
        for f in ("avg", "min", "max")
    ) + " FROM t GROUP BY year, month",
    "seasonal_conditions": "SELECT season, count(*) AS reading_count, " + ", ".join(
        f"round(avg({m}), 2) AS avg_{'do_pct_sat' if m == 'dissolved_oxygen_pct_sat' else m}"
        for m in ("temperature", "dissolved_oxygen", "dissolved_oxygen_pct_sat", "salinity", "turbidity", "ph")
    ) + " FROM t GROUP BY season",
    "weekday_conditions": "SELECT day_of_week, count(*) AS reading_count, round(avg(turbidity), 2) AS avg_turbidity,"
        " round(avg(dissolved_oxygen), 2) AS avg_dissolved_oxygen FROM t GROUP BY day_of_week",
    "hourly_conditions": "SELECT hour, count(*) AS reading_count, round(avg(temperature), 2) AS avg_temperature,"
        " round(avg(dissolved_oxygen_pct_sat), 2) AS avg_do_pct_sat FROM t GROUP BY hour",
    "temperature_change": "WITH m AS (SELECT year, month, round(avg(temperature), 2) AS v FROM t GROUP BY ALL)"
        " SELECT a.year, a.month, a.v AS avg_temperature, b.v AS prev_month_avg_temperature,"
        " round(a.v - b.v, 2) AS change_from_prev_month FROM m a LEFT JOIN m b"
        " ON a.year * 12 + a.month = b.year * 12 + b.month + 1",
    "daytime_ph": "SELECT season, count(*) AS reading_count, round(avg(ph), 3) AS avg_ph, round(min(ph), 3) AS min_ph,"
        " round(max(ph), 3) AS max_ph FROM t WHERE hour BETWEEN 6 AND 17 AND ph IS NOT NULL GROUP BY season",
    "turbid_months": "SELECT year, month, round(avg(turbidity), 2) AS avg_turbidity FROM t GROUP BY year, month"
        " HAVING avg(turbidity) > 2 * (SELECT avg(turbidity) FROM t)",
    "salinity_classes": "SELECT season, CASE WHEN salinity < 0.5 THEN 'Freshwater (< 0.5)' WHEN salinity < 30"
        " THEN 'Brackish (0.5-30)' ELSE 'Saline (>= 30)' END AS salinity_class, count(*) AS reading_count FROM t"
        " WHERE salinity IS NOT NULL GROUP BY 1, 2",
    "rolling_turbidity": "WITH d AS (SELECT CAST(timestamp AS DATE) AS reading_date, round(avg(turbidity), 2)"
        " AS avg_turbidity FROM t WHERE turbidity IS NOT NULL GROUP BY 1) SELECT *, round(avg(avg_turbidity) OVER"
        " (ORDER BY reading_date ROWS 6 PRECEDING), 2) AS rolling_7day_avg_turbidity FROM d",
    "cumulative_oxygen": "WITH d AS (SELECT CAST(timestamp AS DATE) AS reading_date, avg(dissolved_oxygen) AS v FROM t"
        " WHERE dissolved_oxygen IS NOT NULL GROUP BY 1) SELECT reading_date, round(v, 2) AS avg_do,"
        " round(avg(v) OVER (ORDER BY reading_date ROWS UNBOUNDED PRECEDING), 2) AS cumulative_avg_do FROM d",
    "turbidity_ranks": "SELECT year, month, round(avg(turbidity), 2) AS avg_turbidity,"
        " rank() OVER (ORDER BY avg(turbidity) DESC) AS turbidity_rank FROM t WHERE turbidity IS NOT NULL GROUP BY year, month",
    "turbidity_anomalies": "WITH d AS (SELECT CAST(timestamp AS DATE) AS reading_date, avg(turbidity) AS v FROM t"
        " WHERE turbidity IS NOT NULL GROUP BY 1), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM d)"
        " SELECT reading_date, round(v, 2) AS avg_turbidity, round(m, 2) AS dataset_mean_turbidity,"
        " round((v - m) / sd, 2) AS z_score FROM d, s WHERE (v - m) / sd > 3",
    "turbidity_deviations": "WITH d AS (SELECT *, avg(turbidity) OVER (PARTITION BY CAST(timestamp AS DATE)) AS m FROM t"
        " WHERE turbidity IS NOT NULL) SELECT timestamp, turbidity, round(m, 2) AS day_avg_turbidity,"
        " round(turbidity - m, 2) AS deviation_from_day_avg FROM d ORDER BY 4 DESC, timestamp LIMIT 15",
    "turbidity_streaks": "WITH d AS (SELECT CAST(timestamp AS DATE) AS day, avg(turbidity) AS v FROM t"
        " WHERE turbidity IS NOT NULL GROUP BY 1), g AS (SELECT *, count(*) FILTER (WHERE v <= 10) OVER (ORDER BY day)"
        " AS run FROM d) SELECT min(day) AS streak_start, max(day) AS streak_end, count(*) AS streak_length_days,"
        " round(avg(v), 2) AS streak_avg_turbidity FROM g WHERE v > 10 GROUP BY run HAVING count(*) >= 2",
}


@pytest.fixture(scope="module")
def table(spark):
    """A year of readings with missing values, a burst, a hole and odd values."""
    frame = raw_frame(2400, hours=4)
    random = np.random.default_rng(11)
    for i, name in enumerate(["Temperature", "pH", "Salinity", "Turbidity", "Dissolved Oxygen"]):
        frame.loc[random.random(len(frame)) < 0.03 * (i + 1), name] = np.nan
    frame["Turbidity"] = frame["Turbidity"] / 6
    frame.loc[600:630, "Turbidity"] = 45.5
    frame.loc[5, "Chlorophyll"] = -1.0
    frame.loc[:9, "Temperature"] = 31.0
    frame.loc[40:43, "pH"] = 14.5
    frame.loc[50:51, "Average Water Direction"] = 360.5
    frame.loc[60:64, "Dissolved Oxygen (%Saturation)"] = 210.0
    frame = frame.drop(index=range(1500, 1620))
    # a dense day of low oxygen, whose last rows repeat numbers and times
    dense = frame.iloc[:48].copy()
    dense["Timestamp"] = [str(START + timedelta(days=30, minutes=20 * i)) for i in range(48)]
    dense["Record number"] = np.arange(90_000, 90_048)
    dense["Dissolved Oxygen"] = 4.25
    frame = pd.concat([frame, dense, dense.iloc[-5:]], ignore_index=True)
    cleaned = cleaning.clean(to_spark(spark, frame))
    return cleaned.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def con(table):
    con = duckdb.connect()
    t = table.toPandas()  # noqa: F841 - read by name
    con.execute("CREATE TABLE t AS SELECT * FROM t")
    return con


def test_there_are_33_reports():
    assert len(REPORTS) == 33


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_has_rows(table, name):
    assert run_report(table, name).count() > 0


def test_every_report_is_compared():
    assert set(SQL) == set(REPORTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_report_equals_sql(table, con, name):
    ours, theirs = answers(run_report(table, name), con, SQL[name])
    assert ours == theirs


def test_reports_run_as_sql_on_the_registered_table(spark, table):
    from sondeflow.sources import register_view
    register_view(table)
    seasons = spark.sql("SELECT DISTINCT season FROM water_quality ORDER BY season")
    assert rows(seasons) == rows(run_report(table, "seasons"))
    ranked = spark.sql(
        "SELECT year, month, ROUND(AVG(turbidity), 2) AS avg_turbidity, RANK() OVER (ORDER BY AVG(turbidity) DESC)"
        " AS turbidity_rank FROM water_quality WHERE turbidity IS NOT NULL GROUP BY year, month ORDER BY turbidity_rank"
    )
    assert rows(ranked) == rows(run_report(table, "turbidity_ranks").select(*ranked.columns))


def test_dashboard_follows_the_season_filter(table):
    frames = dashboard_frames(table, "turbidity", ["Summer", "Winter"])
    kept, total = frames["rows"].first()
    assert 0 < kept < total == table.count()
    assert {r["season"] for r in frames["season_boxes"].collect()} == {"Summer", "Winter"}
    assert frames["correlation"].count() == 100
    assert frames["hour_pattern"].count() == 6
    assert frames["daily_trend"].count() > 300
    empty = dashboard_frames(table, "turbidity", [])
    assert rows(empty["missing"]) == [(None,)] and empty["daily_trend"].count() == 0


@pytest.mark.parametrize("name", ["turbidity_streaks", "missing_percent", "seasonal_conditions", "turbidity_deviations"])
def test_partitions_do_not_change_a_report(table, name):
    answers_ = [sorted(rows(run_report(table.repartition(n), name)), key=str) for n in (1, 4, 32)]
    assert answers_[0] == answers_[1] == answers_[2]
