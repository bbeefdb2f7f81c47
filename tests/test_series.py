"""Long series in blocks against plain loops."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from sondeflow.functions import steady_mean
from sondeflow.operators import series

from frames import rows

START = datetime(2024, 1, 1)


def readings(spark, parts=4):
    """Series of very different lengths, a hot timestamp, missing values, a run over everything."""
    random = Random(6)
    data = []
    for name, n in (("a", 700), ("b", 1), ("c", 60), (None, 40), ("flat", 300)):
        second = 0
        for i in range(n):
            second += 0 if name == "a" and 200 < i < 500 else random.choice([1, 2, 5000])
            value = 9.0 if name == "flat" else None if random.random() < 0.1 else random.randrange(1000) / 100
            data.append((name, START + timedelta(seconds=second), i, value))
    random.shuffle(data)
    return data, spark.createDataFrame(data, "series string, timestamp timestamp_ntz, n long, value double").repartition(parts)


def by_series(data):
    found = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        found.setdefault(row[0], []).append(row)
    return found


@pytest.fixture(params=[1 << 18, 50, 3])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", request.param)
    return request.param


ORDER = ["timestamp", "n"]


def test_blocks_are_short_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 50)
    _, df = readings(spark)
    blocks = series.in_blocks(df, ["series"], ORDER)
    assert max(r["count"] for r in blocks.groupBy("__block").count().collect()) <= 150
    order = sorted(rows(blocks.where("series = 'a'").select("timestamp", "n", "__block")))
    assert [r[2] for r in order] == sorted(r[2] for r in order) and len({r[2] for r in order}) > 5


@pytest.mark.parametrize("width", [1, 2, 7])
def test_moving_mean(spark, block_rows, width):
    data, df = readings(spark)
    got = {(r["series"], r["n"]): r["rolling_mean"] for r in
           series.moving_mean(df, ["series"], ORDER, "value", width, digits=None).collect()}
    assert len(got) == len(data)
    for name, own in by_series(data).items():
        for i, row in enumerate(own):
            near = [r[3] for r in own[max(0, i - width + 1):i + 1] if r[3] is not None]
            assert got[name, row[2]] == (pytest.approx(sum(near) / len(near)) if near else None)


def test_running_mean(spark, block_rows):
    data, df = readings(spark)
    got = {(r["series"], r["n"]): r["cumulative_mean"] for r in
           series.running_mean(df, ["series"], ORDER, "value", digits=None).collect()}
    assert len(got) == len(data)
    for name, own in by_series(data).items():
        seen = []
        for row in own:
            seen += [] if row[3] is None else [row[3]]
            assert got[name, row[2]] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def plain_streaks(data, low, least, gap):
    found = []
    for name, own in by_series(data).items():
        run = []
        for row in [*own, None]:
            flagged = row is not None and row[3] is not None and row[3] > low
            far = bool(run) and row is not None and gap is not None and (row[1] - run[-1][1]).total_seconds() > gap
            if run and (not flagged or far):
                if len(run) >= least:
                    found.append((name, run[0][1], run[-1][1], len(run), round(sum(r[3] for r in run) / len(run), 6)))
                run = []
            if flagged:
                run.append(row)
    return sorted(found, key=str)


@pytest.mark.parametrize("gap", [None, 100])
def test_streaks(spark, block_rows, gap):
    data, df = readings(spark)
    wanted = plain_streaks(data, 3, 2, gap)
    for parts in (1, 4, 32):
        found = series.series_streaks(
            df.repartition(parts), ["series"], ORDER, F.col("value") > 3, 2, "value", digits=6, longest_gap=gap)
        assert sorted(rows(found), key=str) == wanted
    assert max(w[3] for w in wanted) == 300 or gap


def test_no_rows(spark):
    _, df = readings(spark)
    none = df.limit(0)
    assert series.moving_mean(none, ["series"], ORDER, "value").collect() == []
    assert series.running_mean(none, ["series"], ORDER, "value").collect() == []
    assert series.series_streaks(none, ["series"], ORDER, F.col("value") > 3).collect() == []


def test_a_value_finer_than_its_resolution_raises(spark):
    fine = spark.createDataFrame([(1.25,), (3.125,)], "v double")
    assert fine.agg(steady_mean("v", 3)).first()[0] == pytest.approx(2.1875)
    with pytest.raises(Exception, match="more than 2 decimals: 3.125"):
        fine.agg(steady_mean("v", 2)).collect()
    large = spark.createDataFrame([(9_999_999_999.99,), (0.01,)], "v double")
    assert large.agg(steady_mean("v", 2)).first()[0] == 5_000_000_000.0
