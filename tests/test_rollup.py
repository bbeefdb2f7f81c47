"""Summaries from hourly states against those from all readings; tables stored by a key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sondeflow.operators import conditions, duplicates, quality, temporal
from sondeflow.operators.rollup import Rollup
from sondeflow.sources import save_table

from frames import ROWS, rows

COLUMNS = ["turbidity", "ph", "temperature"]
ROLLUP = Rollup(COLUMNS, 4, {"high": "turbidity > 20", "odd": "temperature < 15 OR temperature > 30"})


@pytest.fixture(scope="module")
def readings(clean):
    """With missing values, an hour of many readings, and one reading without a time."""
    df = clean.withColumn("ph", F.when(F.col("record_number") % 3 > 0, F.col("ph")))
    df = df.withColumn("turbidity", F.when(F.col("month") != 5, F.col("turbidity")))
    bare = df.limit(1)
    for c in ("timestamp", "year", "month", "day", "hour", "day_of_week", "season"):
        bare = bare.withColumn(c, F.lit(None).cast(bare.schema[c].dataType))
    return df.unionAll(df.where("month = 3")).unionAll(df.limit(1).crossJoin(df.sparkSession.range(50)).drop("id")).unionAll(bare).cache()


REPORTS = [
    (ROLLUP.monthly_coverage, temporal.monthly_coverage),
    (lambda s: ROLLUP.monthly_summary(s, COLUMNS), lambda df: temporal.monthly_summary(df, COLUMNS, resolution=4)),
    (lambda s: ROLLUP.seasonal_summary(s, COLUMNS), lambda df: temporal.seasonal_summary(df, COLUMNS, resolution=4)),
    (lambda s: ROLLUP.weekday_summary(s, COLUMNS), lambda df: temporal.weekday_summary(df, COLUMNS, resolution=4)),
    (lambda s: ROLLUP.hourly_cycle(s, COLUMNS), lambda df: temporal.hourly_cycle(df, COLUMNS, resolution=4)),
    (lambda s: ROLLUP.condition_by_month(s, "high"), lambda df: conditions.readings_above_by_month(df, "turbidity", 20)),
    (lambda s: ROLLUP.hours_summary_by_season(s, "ph"), lambda df: conditions.hours_summary_by(df, "season", "ph", resolution=4)),
    (lambda s: ROLLUP.condition_share_by_season(s, "temperature", "odd"),
     lambda df: conditions.atypical_share(df, "season", "temperature", 15, 30)),
]


@pytest.fixture(scope="module")
def store(spark, readings, tmp_path_factory):
    """Three loads, the last of which is late, repeated and first failed half way."""
    path = str(tmp_path_factory.mktemp("rollup") / "store")
    n = F.col("record_number") % 5
    ROLLUP.load(readings.where(n < 2), path, "a")
    ROLLUP.load(readings.where(n == 2), path, "b")
    ROLLUP.load(readings.where(n == 3), path, "late")
    ROLLUP.load(readings.where(n >= 3), path, "late")
    return path


@pytest.mark.parametrize("number", range(len(REPORTS)))
def test_summaries_equal_those_of_all_readings(spark, readings, store, number):
    from_store, direct = REPORTS[number]
    wanted = direct(readings)
    found = from_store(ROLLUP.read(spark, store)).select(*wanted.columns)
    assert sorted(rows(found), key=str) == sorted(rows(wanted), key=str) and wanted.count()


def test_a_compacted_store_is_the_same(spark, store, tmp_path):
    ROLLUP.compact(spark, store, str(tmp_path / "one"))
    one, many = ROLLUP.read(spark, str(tmp_path / "one")), ROLLUP.read(spark, store)
    assert sorted(rows(one), key=str) == sorted(rows(many.select(*one.columns)), key=str)
    assert spark.read.parquet(str(tmp_path / "one")).count() == one.count()


def test_duplicate_checks_on_a_bucketed_table_move_no_readings(spark, clean):
    doubled = clean.unionAll(clean.where("record_number % 50 = 0"))
    save_table(doubled, "bucketed_readings", "record_number", 8)
    table = spark.table("bucketed_readings")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checks = {
            "rows": duplicates.duplicate_key_rows(table, "record_number"),
            "groups": duplicates.repeated_keys(table, "record_number"),
            "excess": duplicates.excess_rows(table, ["record_number"]),
            "gate": quality.gate_report(table, ROWS),
        }
        for check in checks.values():
            assert "hashpartitioning" not in check._jdf.queryExecution().executedPlan().toString()
        assert checks["rows"].count() == 2 * checks["groups"].count() == 2 * checks["excess"].first()[0] > 10
        assert {r["check"]: r["passed"] for r in checks["gate"].collect()}["key_unique"] is False
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    save_table(clean, "bucketed_readings", "record_number", 8)
    assert spark.table("bucketed_readings").count() == ROWS
