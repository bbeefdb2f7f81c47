"""Moments and the intervals that cover them."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from sondeflow.operators import conditions, filters, series as blocks
from sondeflow.operators.intervals import covering

from frames import rows, series

ZERO = datetime(1969, 12, 31, 12)


def moments(spark, micros):
    data = [(i, None if m is None else ZERO + timedelta(microseconds=m)) for i, m in enumerate(micros)]
    return spark.createDataFrame(data, "i long, moment timestamp_ntz")


def intervals(spark, bounds):
    at = lambda m: None if m is None else ZERO + timedelta(microseconds=m)
    return spark.createDataFrame(
        [(n, at(a), at(b)) for n, (a, b) in enumerate(bounds)], "event long, start timestamp_ntz, end timestamp_ntz"
    )


def cases():
    random = Random(3)
    day = 86_400_000_000
    points = [random.randrange(3 * day) for _ in range(300)] + [0, 1, 2, 7, 8, 1 << 40, None, 5_000_000] * 3
    bounds = [(None, 5), (5, None), (9, 8), (0, 0), (1, 2), (7, 8), (0, 3 * day), (1 << 40, 1 << 40)]
    for scale in (1, 1000, 10**6, 10**9, day):
        for _ in range(60):
            a = random.choice([p for p in points if p is not None]) - random.randrange(scale + 1)
            bounds.append((a, a + random.randrange(scale + 1)))
    for k in range(0, 42):
        bounds += [(0, (1 << k) - 1), (3, 3 + (1 << k))]
    return points, bounds


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_equal_a_plain_search(spark, parts):
    points, bounds = cases()
    found = covering(moments(spark, points).repartition(parts), "moment", intervals(spark, bounds).repartition(parts))
    assert found.columns == ["i", "moment", "event", "start", "end"]
    pairs = [(r["i"], r["event"]) for r in found.collect()]
    wanted = {
        (i, n) for i, p in enumerate(points) for n, (a, b) in enumerate(bounds)
        if None not in (p, a, b) and a <= p <= b
    }
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted


def test_uncovered_moments_stay_in_a_left_join(spark):
    points, bounds = cases()
    found = covering(moments(spark, points), "moment", intervals(spark, bounds[:5]), how="left")
    inner = covering(moments(spark, points), "moment", intervals(spark, bounds[:5]))
    alone = {r["i"] for r in found.where("event IS NULL").collect()}
    covered = {r["i"] for r in inner.collect()}
    assert alone == set(range(len(points))) - covered and covered
    assert found.where("event IS NOT NULL").count() == inner.count()


def test_no_intervals_and_no_moments(spark):
    none = intervals(spark, [])
    assert covering(moments(spark, [1, 2]), "moment", none).collect() == []
    assert covering(moments(spark, [1, 2]), "moment", none, how="left").count() == 2
    assert covering(moments(spark, []), "moment", intervals(spark, [(0, 1)]), how="left").collect() == []


def test_no_nested_loop(spark):
    many = spark.range(100_000).select(
        F.col("id").alias("event"), (F.lit(ZERO) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("start")
    ).withColumn("end", F.col("start") + F.make_dt_interval(secs=F.lit(500)))
    for how in ("inner", "left"):
        found = covering(moments(spark, range(0, 10**10, 10**8)), "moment", many, how=how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert covering(moments(spark, [60_000_000_000]), "moment", many).count() == 501


def test_a_table_of_events_annotates_days_like_a_list(spark):
    days = series(spark, [("2024-05-16", 1.0), ("2024-05-17", 2.0), ("2024-05-23", 3.0), ("2024-05-24", 4.0)])
    days = days.unionAll(days.limit(1).select(F.lit(None).cast("date"), "value"))
    listed = [("2024-05-17 00:00:00", "2024-05-23 00:00:00", "a"), ("2024-05-23 08:00:00", "2024-05-24 00:00:00", "b")]
    table = filters.event_windows(spark, listed)
    assert sorted(rows(filters.annotate_events(days, table)), key=str) == sorted(rows(filters.annotate_events(days, listed)), key=str)


def valued(spark, points):
    """Readings at some moments; every seventh has no value."""
    read = moments(spark, points).withColumn("value", F.when(F.col("i") % 7 > 0, F.col("i") * 1.25 - 400))
    return read.withColumnRenamed("moment", "timestamp")


@pytest.mark.parametrize("rows_of_block", [50, 1 << 18])
def test_means_of_events_need_no_pairs(spark, monkeypatch, rows_of_block):
    def pairs(*_):
        raise AssertionError("every reading is paired with every event that covers it")

    points, bounds = cases()
    readings = valued(spark, points)
    # two events of one key count as one of both lengths
    events = intervals(spark, bounds + bounds[:40]).withColumn("event", F.when(F.col("event") < 500, F.col("event") % 400))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows_of_block)
    paired = rows(conditions.event_table_means(readings, ["value"], events, digits=2))
    monkeypatch.setattr(conditions, "covering", pairs)
    summed = conditions.event_table_means(readings, ["value"], events, digits=2, resolution=2)
    assert sorted(rows(summed), key=str) == sorted(paired, key=str)
    assert {r["readings"] for r in summed.collect()} > {0, 1}
    none = conditions.event_table_means(readings, ["value"], events.limit(0), resolution=2)
    assert none.collect() == []
    empty = conditions.event_table_means(readings.limit(0), ["value"], events, resolution=2)
    assert {(r["readings"], r["value_mean"]) for r in empty.collect()} == {(0, None)}


@pytest.mark.parametrize("value", [0.125, float("nan"), float("inf"), 1e300])
def test_a_value_finer_than_the_resolution_matters_where_it_is_covered(spark, value):
    odd = moments(spark, [1, 5, 9]).withColumnRenamed("moment", "timestamp").withColumn(
        "value", F.when(F.col("i") == 1, F.lit(value)).otherwise(F.lit(2.5))
    )
    beside = conditions.event_table_means(odd, ["value"], intervals(spark, [(0, 4), (6, 9)]), resolution=2)
    assert [(r["readings"], r["value_mean"]) for r in beside.orderBy("event").collect()] == [(1, 2.5), (1, 2.5)]
    with pytest.raises(Exception, match="more than 2 decimals"):
        conditions.event_table_means(odd, ["value"], intervals(spark, [(0, 5)]), resolution=2).collect()
