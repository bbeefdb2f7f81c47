from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeflow.functions import band, steady_mean
from sondeflow.operators import cleaning, conditions, filters, missingness, temporal, windows
from sondeflow.schema import OXYGEN_BANDS, SALINITY_BANDS

from frames import ROWS, START, readings, rows, series


def months(spark, triples):
    return spark.createDataFrame(triples, "year int, month int, value double")


def test_month_over_month_follows_the_calendar(spark):
    df = months(spark, [(2023, 11, 1.0), (2023, 12, 2.0), (2024, 1, 4.0), (2024, 3, 9.0), (2024, 4, 8.5)])
    found = rows(temporal.month_over_month(df, "value"))
    assert [r[3:] for r in found] == [(None, None), (1.0, 1.0), (2.0, 2.0), (None, None), (9.0, -0.5)]


def test_month_over_month_rounds_before_it_subtracts(spark):
    df = months(spark, [(2024, 1, 1.004), (2024, 2, 1.006)])
    assert rows(temporal.month_over_month(df, "value"))[1] == (2024, 2, 1.01, 1.0, 0.01)
    full = rows(temporal.month_over_month(df, "value", digits=None))[1]
    assert full[4] == pytest.approx(0.002)


def test_calendar_is_filled(spark):
    df = readings(spark, [("2024-02-27 10:00", 1.0), ("2024-02-27 11:00", 3.0), ("2024-03-02 00:00", None),
                          ("2024-03-03 05:00", 5.0), (None, 100.0)])
    found = [(str(d), v) for d, v in rows(temporal.daily_mean_calendar(df, "value").orderBy("date"))]
    assert found == [
        ("2024-02-27", 2.0), ("2024-02-28", None), ("2024-02-29", None), ("2024-03-01", None),
        ("2024-03-02", None), ("2024-03-03", 5.0),
    ]
    present = [(str(d), v) for d, v in rows(temporal.daily_mean(df, "value").where("date is not null").orderBy("date"))]
    assert present == [("2024-02-27", 2.0), ("2024-03-03", 5.0)]


def test_calendar_of_one_day_and_of_nothing(spark):
    one = readings(spark, [("2024-02-27 10:00", 1.0)])
    assert temporal.daily_mean_calendar(one, "value").count() == 1
    assert temporal.daily_mean_calendar(one.limit(0), "value").count() == 0


def test_summaries_match_pandas(clean):
    frame = clean.toPandas()
    monthly = frame.groupby(["year", "month"])[["ph", "turbidity"]].agg(["mean", "min", "max"])
    found = temporal.monthly_summary(clean, ["ph", "turbidity"], digits=None).toPandas().set_index(["year", "month"])
    for column in ("ph", "turbidity"):
        for kind in ("mean", "min", "max"):
            pd.testing.assert_series_equal(
                found[f"{column}_{kind}"], monthly[(column, kind)], check_names=False, check_index_type=False
            )
    seasonal = temporal.seasonal_summary(clean, ["ph"], digits=None).toPandas()
    assert list(seasonal["season"]) == ["Summer", "Autumn", "Winter", "Spring"]
    means = frame.groupby("season")["ph"].mean()
    assert list(seasonal["ph_mean"]) == pytest.approx([means[s] for s in seasonal["season"]])
    assert list(temporal.weekday_summary(clean, ["ph"]).toPandas()["day_of_week"])[::6] == ["Monday", "Sunday"]
    hours = frame.groupby("hour").size()
    assert dict(rows(temporal.hourly_cycle(clean, ["ph"]).select("hour", "reading_count"))) == hours.to_dict()


def test_steady_mean_ignores_the_order_of_rows(spark):
    values = spark.range(100_000).select((F.pmod(F.col("id") * 7919, F.lit(100_003)) / 100 - 300).alias("v"))
    plain = values.agg(steady_mean("v")).first()[0]
    means = {
        values.repartition(n, F.rand(n)).agg(steady_mean("v", 2)).first()[0] for n in (1, 4, 32)
    }
    assert len(means) == 1
    assert means.pop() == pytest.approx(plain)
    assert rows(values.where("false").agg(steady_mean("v", 2))) == [(None,)]


def test_groups_without_a_time_are_kept_or_dropped(spark):
    df = cleaning.add_time_features(readings(spark, [("2024-01-01", 1.0), (None, 5.0)]))
    assert temporal.monthly_summary(df, ["value"]).count() == 2
    assert temporal.monthly_summary(df, ["value"], null_groups=False).count() == 1
    assert rows(temporal.seasonal_summary(df, ["value"])) == [(None, 1, 5.0), ("Summer", 1, 1.0)]
    assert rows(temporal.seasonal_summary(df, ["value"], null_groups=False)) == [("Summer", 1, 1.0)]


def test_month_shape(spark):
    df = months(spark, [(2023, 1, 1.0), (2024, 1, 3.0), (2024, 2, 6.0), (2024, 3, 4.0)]).withColumn("flat", F.lit(1.0))
    assert rows(temporal.month_shape(df, ["value", "flat"])) == [(1, 0.0, None), (2, 1.0, None), (3, 0.5, None)]


@pytest.mark.parametrize("bands, cases", [
    (OXYGEN_BANDS, {-1.0: "Low (< 4 mg/L)", 4.0: "Moderate (4-6 mg/L)", 6.0: "Good (6-8 mg/L)", 8.0: "High (>= 8 mg/L)"}),
    (SALINITY_BANDS, {0.49: "Freshwater (< 0.5)", 0.5: "Brackish (0.5-30)", 30.0: "Saline (>= 30)"}),
])
def test_bounds_belong_to_the_upper_band(spark, bands, cases):
    df = spark.createDataFrame([(v,) for v in [*cases, None]], "v double")
    assert dict(rows(df.select("v", band("v", bands)))) == {**cases, None: None}
    assert sum(n for _, n in rows(conditions.band_counts(df, "v", bands))) == len(cases)


def test_event_window_ends_at_midnight_unless_whole_days(spark):
    df = readings(spark, [("2024-05-16 23:59", 1.0), ("2024-05-17 00:00", 2.0), ("2024-05-23 00:00", 3.0), ("2024-05-23 10:00", 4.0)])
    window = ("2024-05-17 00:00:00", "2024-05-23 00:00:00")
    assert [r["value"] for r in filters.between_times(df, *window).orderBy("timestamp").collect()] == [2.0, 3.0]
    assert [r["value"] for r in filters.between_times(df, *window, whole_days=True).orderBy("timestamp").collect()] == [2.0, 3.0, 4.0]
    assert rows(conditions.event_means(df, ["value"], *window)) == [("value", 2.5, 2.5)]


def test_time_window_prunes_month_folders(spark, clean, tmp_path):
    from sondeflow.sources import read_clean_parquet, write_clean_parquet
    path = str(tmp_path / "clean")
    write_clean_parquet(clean, path)
    kept = filters.between_times(
        read_clean_parquet(spark, path), "2021-04-01", "2021-05-16 01:30:00", year_column="year", month_column="month"
    )
    times = [START + timedelta(hours=15 * i) for i in range(ROWS)]
    assert kept.count() == sum(datetime(2021, 4, 1) <= t < datetime(2021, 5, 16, 1, 30) for t in times)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan


def test_overlapping_events_give_one_row_each(spark):
    days = series(spark, [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-05", 3.0)])
    events = [("2024-01-01 00:00:00", "2024-01-02 00:00:00", "a"), ("2024-01-02 00:00:00", "2024-01-03 00:00:00", "b")]
    found = sorted((str(d), label or "") for d, _, label in rows(filters.annotate_events(days, events)))
    assert found == [("2024-01-01", "a"), ("2024-01-02", "a"), ("2024-01-02", "b"), ("2024-01-05", "")]


def test_empty_selection_keeps_nothing(clean):
    assert filters.in_seasons(clean, []).count() == 0
    assert filters.in_seasons(clean, ["Summer"]).count() > 0


def test_missing_percent_of_nothing_is_null(clean):
    assert rows(missingness.missing_pct(clean.limit(0), "ph")) == [(None,)]


def test_months_above_the_overall_mean(spark):
    df = months(spark, [(2024, 1, 1.0), (2024, 1, 1.0), (2024, 2, 1.0), (2024, 3, 9.0), (2024, 4, None)])
    for resolution in (None, 2):
        found = rows(conditions.months_above_overall_mean(df, "value", 2.0, resolution=resolution))
        assert found == [(2024, 3, 9.0)]


def test_rolling_mean_counts_present_days(spark):
    days = series(spark, [("2024-01-01", 1.0), ("2024-01-05", 2.0), ("2024-01-06", 6.0)])
    assert [r[2] for r in rows(windows.rolling_mean(days, 2))] == [1.0, 1.5, 4.0]
    assert [r[2] for r in rows(windows.cumulative_mean(days))] == [1.0, 1.5, 3.0]


def test_rank_leaves_gaps_after_ties(spark):
    df = months(spark, [(2024, 1, 5.0), (2024, 2, 7.0), (2024, 3, 7.0), (2024, 4, 1.0)])
    assert [(r["month"], r["rank"]) for r in windows.rank_months(df, "value").collect()] == [(2, 1), (3, 1), (1, 3), (4, 4)]


def test_low_days_need_enough_readings(spark):
    df = cleaning.add_time_features(readings(spark, [
        ("2024-01-01 01:00", 5.0), ("2024-01-01 02:00", 4.0), ("2024-01-02 01:00", 1.0), ("2024-01-03 01:00", 9.0),
        ("2024-01-03 02:00", 9.0),
    ]))
    assert rows(conditions.low_days(df, "value", 6, 2)) == [(2024, 1, 1, 2, 4.5)]
