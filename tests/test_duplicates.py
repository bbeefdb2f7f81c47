from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sondeflow import scale
from sondeflow.operators import duplicates, windows

from frames import readings, rows

IDS = [None, None, 1, 2, 2, 3, 3, 3, 4]


@pytest.fixture
def ids(spark):
    return spark.createDataFrame([(i, n) for n, i in enumerate(IDS)], "record_number bigint, n int")


def test_rows_of_repeated_numbers_leave_out_null(ids):
    found = duplicates.duplicate_key_rows(ids, "record_number")
    assert sorted(r[1] for r in rows(found.select("record_number", "n"))) == [3, 4, 5, 6, 7]


def test_groups_take_null_as_a_value(ids):
    assert set(rows(duplicates.repeated_keys(ids, "record_number"))) == {(None, 2), (2, 2), (3, 3)}
    assert rows(duplicates.excess_rows(ids, ["record_number"])) == [(4,)]


def test_full_duplicates_match_null_with_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2.0), (2, None)], "a int, b double")
    assert rows(duplicates.full_duplicates(df)) == [(1, None), (1, None)]
    assert rows(duplicates.excess_rows(df)) == [(1,)]


def test_many_copies_are_written_back_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "_COPIES_PER_CHUNK", 100)
    df = spark.range(1000).select(F.when(F.col("id") < 701, 7).otherwise(F.col("id")).alias("a"))
    found = duplicates.full_duplicates(df)
    assert found.count() == 701
    assert rows(found.distinct()) == [(7,)]


def test_nothing_to_report(spark):
    empty = spark.createDataFrame([], "record_number bigint, timestamp timestamp_ntz")
    assert duplicates.full_duplicates(empty).count() == 0
    assert duplicates.duplicate_key_rows(empty, "record_number").count() == 0
    assert rows(duplicates.excess_rows(empty)) == [(0,)]


def test_top_repeated_breaks_ties_by_value(spark):
    df = readings(spark, [("2024-01-02", 0), ("2024-01-02", 0), ("2024-01-01", 0), ("2024-01-01", 0),
                          ("2024-01-03", 0), ("2024-01-03", 0), ("2024-01-03", 0), ("2024-01-04", 0)])
    found = [(str(t)[:10], n) for t, n in rows(duplicates.top_repeated(df, k=2))]
    assert found == [("2024-01-03", 3), ("2024-01-01", 2)]


def test_rows_sharing_a_timestamp(spark):
    df = readings(spark, [("2024-01-02", 0), ("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)])
    found = duplicates.rows_sharing(df, show=["record_number", "value"])
    assert rows(found) == [(0, 0.0), (2, 2.0)]


@pytest.fixture
def skewed(spark):
    """A third of the rows under one key, many keys under the rest."""
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 7000).alias("key"),
        F.col("id").alias("n"),
    )


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_spread_join_is_the_same_join(skewed, how):
    groups = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.max("n").alias("top"))
    groups = groups.where("w > 3")
    plain = skewed.join(groups.drop("w"), "key", how)
    spread = scale.spread_join(skewed, scale.materialized(groups), ["key"], "w", how).drop("w")
    plain = plain.select(*spread.columns)
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()


def test_hot_keys_never_reach_the_shuffle(skewed, monkeypatch):
    monkeypatch.setattr(scale, "HOT_SHARE", 0.01)
    groups = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    spread = scale.spread_join(skewed, scale.materialized(groups), ["key"], "w", "left_semi")
    assert spread.count() == 30_000
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan


def test_building_a_row_join_runs_no_job(spark, skewed):
    df = readings(spark, [("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:00", 2.0)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may start")
    try:
        duplicates.duplicate_key_rows(skewed, "key")
        duplicates.rows_sharing(df)
        windows.deviation_from_day(df, "value")
        windows.largest_deviations(df, "value")
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_hot_key_is_split(spark, skewed):
    """A third of the rows under one key do not meet in one task."""
    wide = skewed.withColumn("payload", F.sha2(F.col("n").cast("string"), 512)).repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = duplicates.duplicate_key_rows(wide, "key").withColumn("task", F.spark_partition_id())
        hot = found.where("key = -1").groupBy("task").count().collect()
        assert sum(r["count"] for r in hot) == 10_000 and len(hot) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
