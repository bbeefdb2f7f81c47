from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sondeflow.operators import gaps

from frames import readings, rows


def brute(times):
    """Consecutive differences in microseconds and the times they end at."""
    ordered = pd.Series(sorted(pd.Timestamp(t) for t in times if t is not None))
    steps = ordered.diff().dropna()
    return [(ordered[i], int(d.value // 1000)) for i, d in steps.items()]


def random_times(seed):
    random = np.random.default_rng(seed)
    steps = random.choice([0, 1, 999, 10**6, 59 * 10**6, 7 * 10**8, 9 * 10**9, 3 * 10**11], 600)
    start = pd.Timestamp("2023-12-30 23:59:59.5")
    return [start + pd.Timedelta(microseconds=int(m)) for m in np.cumsum(steps)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("seconds", [0.0005, 1, 61.7, 7200, 86_400, 200_000])
def test_gap_report_equals_a_global_lag(spark, seed, seconds):
    times = random_times(seed)
    df = readings(spark, [(t, 0.0) for t in [*times[::-1], None]])
    found = [(t, round(s * 10**6)) for t, s in rows(gaps.gap_report(df, seconds))]
    assert found == [(t.to_pydatetime(), us) for t, us in brute(times) if us > seconds * 10**6]


@pytest.mark.parametrize("unit", [None, 60, 0.001])
def test_interval_counts_equal_a_global_lag(spark, unit):
    times = random_times(3)
    df = readings(spark, [(t, 0.0) for t in [*times, None]])
    step = round((unit or 1e-6) * 10**6)
    expected = pd.Series([us // step * step for _, us in brute(times)]).value_counts()
    found = {round(s * 10**6): n for s, n in rows(gaps.interval_counts(df, None, unit_seconds=unit))}
    assert found == expected.to_dict()
    top = rows(gaps.interval_counts(df, 3, unit_seconds=unit))
    assert [n for _, n in top] == sorted(expected, reverse=True)[:3]


def test_no_window_is_large_at_a_millisecond(spark):
    """Ten readings a millisecond for a minute: slots meet in short units first."""
    from pyspark.sql import functions as F

    start = 1_704_067_200_000_000
    df = spark.range(200_000).select(F.timestamp_micros(F.lit(start) + F.col("id") * 100).alias("timestamp"))
    late = spark.createDataFrame([(start + 20_000_000 + 1_500,)], "t long").select(F.timestamp_micros("t").alias("timestamp"))
    seen, plain = [], gaps._between_slots

    def watched(slots, width):
        seen.append(slots.groupBy(gaps._floor(F.col("low"), gaps._UNITS[0])).count().agg(F.max("count")).first()[0])
        return plain(slots, width)

    gaps._between_slots = watched
    try:
        found = gaps.gap_report(df.union(late), 0.001).collect()
    finally:
        gaps._between_slots = plain
    assert [r["gap_seconds"] for r in found] == [0.0016] and max(seen) <= 50


def test_exactly_the_limit_is_no_gap(spark):
    df = readings(spark, [("2024-01-01 00:00", 0), ("2024-01-01 02:00", 0), ("2024-01-01 04:00:00.000001", 0)])
    assert rows(gaps.gap_report(df, 7200)) == [(dt.datetime(2024, 1, 1, 4, 0, 0, 1), 7200.000001)]


def test_gap_over_empty_days(spark):
    df = readings(spark, [("2024-04-16 10:00", 0), ("2024-05-17 00:10", 0), ("2024-05-17 00:20", 0)])
    (end, seconds), = rows(gaps.gap_report(df))
    assert end == dt.datetime(2024, 5, 17, 0, 10) and seconds / 86_400 == pytest.approx(30.59, abs=0.01)


def test_too_few_readings(spark):
    one = readings(spark, [("2024-01-01 00:00", 0)])
    for df in (one, one.limit(0)):
        assert rows(gaps.gap_report(df)) == [] and rows(gaps.interval_counts(df)) == []


def test_one_timestamp_with_most_readings(spark):
    df = readings(spark, [("2024-01-01 00:00", 0)] * 500 + [("2024-01-01 00:01", 0)])
    assert rows(gaps.interval_counts(df)) == [(0.0, 499), (60.0, 1)]
