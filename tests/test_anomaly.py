from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sondeflow.operators import anomaly, temporal

from frames import readings, rows, series

DAY = dt.date(2024, 1, 1)


def day(n: int) -> str:
    return str(DAY + dt.timedelta(days=n))


def spans(df):
    return [(str(a), str(b), n) for a, b, n, *_ in rows(df)]


def flags(spark, pattern: str, start: int = 0):
    """One day per character: x flagged, . not, ? unknown, blank no such day."""
    known = {"x": True, ".": False, "?": None}
    return series(
        spark, [(day(start + i), known[c]) for i, c in enumerate(pattern) if c != " "],
        "is_flagged", "boolean",
    )


@pytest.mark.parametrize("pattern, expected", [
    ("....", []),
    ("xxxx", [(0, 3)]),
    ("x.xx", [(2, 3)]),
    ("xx.x", [(0, 1)]),
    ("xx?xx", [(0, 1), (3, 4)]),
])
def test_runs(spark, pattern, expected):
    found = spans(anomaly.find_streaks(flags(spark, pattern)))
    assert found == [(day(a), day(b), b - a + 1) for a, b in expected]


def test_a_missing_day_ends_a_run_only_on_request(spark):
    days = flags(spark, "xx xx")
    assert spans(anomaly.find_streaks(days)) == [(day(0), day(4), 4)]
    assert spans(anomaly.find_streaks(days, gap_breaks=True)) == [(day(0), day(1), 2), (day(3), day(4), 2)]


def test_minimum_length_and_empty_input(spark):
    days = flags(spark, "x.xx.xxx")
    assert [n for *_, n in spans(anomaly.find_streaks(days, min_length=3))] == [3]
    assert len(spans(anomaly.find_streaks(days, min_length=1))) == 3
    empty = anomaly.find_streaks(days.limit(0))
    assert rows(empty) == [] and empty.columns == ["streak_start", "streak_end", "streak_length_days"]


def test_full_calendar_and_present_days_differ_on_an_outage(spark):
    df = readings(spark, [(f"{day(n)} 12:00", 20.0) for n in (0, 1, 4, 5)] + [(f"{day(6)} 12:00", 1.0)])
    present = anomaly.high_streaks(temporal.daily_mean(df, "value"), 10)
    assert rows(present)[0][2:] == (4, 20.0)
    calendar = temporal.daily_mean_calendar(df, "value")
    flagged = calendar.withColumn("is_flagged", F.col("value") > 10)
    assert spans(anomaly.find_streaks(flagged)) == [(day(0), day(1), 2), (day(4), day(5), 2)]


def test_longest_run_first(spark):
    days = series(spark, [(day(i), v) for i, v in enumerate([11, 12, 1, 13, 14, 15, 2, 30])], type_="int")
    assert rows(anomaly.high_streaks(days, 10)) == [
        (dt.date(2024, 1, 4), dt.date(2024, 1, 6), 3, 14.0),
        (dt.date(2024, 1, 1), dt.date(2024, 1, 2), 2, 11.5),
    ]


def test_high_days_are_one_sided_and_use_the_population(spark):
    values = [0.0] * 20 + [10.0]
    days = series(spark, [(day(i), v) for i, v in enumerate(values)])
    (date, value, mean, z), = rows(anomaly.high_days(days))
    assert (str(date), value, mean) == (day(20), 10.0, 0.48)
    assert z == pytest.approx(4.47, abs=0.005)
    low = series(spark, [(day(i), -v) for i, v in enumerate(values)])
    assert rows(anomaly.high_days(low)) == []


def test_flags_are_two_sided_and_use_the_sample(spark):
    values = [0.0, 0.2] * 20 + [-10.0, None]
    days = series(spark, [(day(i), v) for i, v in enumerate(values)])
    flagged = anomaly.flag_anomalous_days(days)
    assert [str(r["date"]) for r in flagged.where("is_flagged").collect()] == [day(40)]
    assert flagged.where("is_flagged is null").count() == 0


def test_a_constant_series_has_no_anomalies(spark):
    days = series(spark, [(day(i), 5.0) for i in range(10)])
    assert anomaly.flag_anomalous_days(days).where("is_flagged").count() == 0
    assert rows(anomaly.high_days(days)) == []


def test_one_day_has_no_deviation(spark):
    days = series(spark, [(day(0), 5.0)])
    assert rows(anomaly.flag_anomalous_days(days).select("is_flagged")) == [(False,)]


def test_counts_and_the_most_flagged_column(spark):
    df = readings(spark, [(f"{day(i)} 10:00", 100.0 if i == 30 else float(i % 2)) for i in range(40) if i != 5])
    df = df.withColumn("calm", F.lit(1.0)).withColumn("twin", F.col("value"))
    columns = ["calm", "twin", "value"]
    flagged = anomaly.flagged_days(df, columns)
    assert flagged.count() == 120
    assert rows(anomaly.flagged_day_counts(flagged, columns)) == [("twin", 1), ("value", 1), ("calm", 0)]
    assert rows(anomaly.most_flagged_days(flagged, columns)) == [("twin", day(30), 100.0)]
