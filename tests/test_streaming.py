"""Replays in several batches against the batch operators."""

from __future__ import annotations

import pytest

from sondeflow import streaming
from sondeflow.operators import duplicates, temporal
from sondeflow.sources import read_raw_csv
from sondeflow.operators.cleaning import clean

from frames import raw_frame, rows


@pytest.fixture
def folders(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    return raw, str(tmp_path / "out"), str(tmp_path / "checkpoint")


def frame():
    readings = raw_frame(400, hours=5)
    readings["Timestamp"] = readings["Timestamp"].where(readings.index % 9 > 0, readings["Timestamp"].shift(1))
    readings.loc[0, "Timestamp"] = readings.loc[1, "Timestamp"]
    return readings


def run(spark, folders, kind):
    raw, out, checkpoint = folders
    readings = streaming.raw_stream(spark, str(raw))
    if kind == "days":
        changes, keys = streaming.daily_means(readings, "turbidity", 4, digits=6), ["date"]
    else:
        changes, keys = streaming.repeated_timestamps(readings), ["timestamp"]
    streaming.update(changes, out, checkpoint)
    return sorted(rows(streaming.latest(spark, out, keys, changes.schema)))


def batch(spark, raw, kind):
    table = clean(read_raw_csv(spark, str(raw)))
    if kind == "days":
        return sorted(rows(temporal.daily_mean(table, "turbidity", digits=6, resolution=4)))
    return sorted(rows(duplicates.repeated_keys(table, "timestamp")))


@pytest.mark.parametrize("kind", ["days", "times"])
def test_a_replay_in_several_batches_equals_the_batch(spark, folders, kind):
    raw, *_ = folders
    whole = frame()
    late = whole.index % 50 == 20
    for n, part in enumerate([whole[:150], whole[150:151], whole[151:]]):
        part[~late[part.index]].to_csv(raw / f"{n}.csv", index=False)
        found = run(spark, folders, kind)
    assert found == batch(spark, raw, kind) and len(found) > 10
    assert run(spark, folders, kind) == found  # nothing has come
    # late by less than the watermark allows
    whole[late][-1:].to_csv(raw / "late.csv", index=False)
    assert run(spark, folders, kind) == batch(spark, raw, kind)


def test_rows_that_come_too_late_or_again_do_not_count(spark, folders):
    raw, *_ = folders
    whole = frame()
    whole[:300].to_csv(raw / "0.csv", index=False)
    run(spark, folders, "days")
    whole[300:].to_csv(raw / "1.csv", index=False)
    before = run(spark, folders, "days")
    wanted = batch(spark, raw, "days")
    again, old = whole[-3:].copy(), whole[:2].copy()
    old["Record number"] += 100_000
    again.to_csv(raw / "2.csv", index=False)
    old.to_csv(raw / "3.csv", index=False)
    assert run(spark, folders, "days") == before == wanted


def test_a_batch_that_failed_is_written_again(spark, folders):
    """The state has moved on, but the table lacks the batch: the next run repeats it."""
    raw, out, checkpoint = folders
    whole = frame()
    whole[:200].to_csv(raw / "0.csv", index=False)
    readings = streaming.raw_stream(spark, str(raw))
    changes = streaming.daily_means(readings, "turbidity", 4, digits=6)

    def fail(batch, number):
        raise OSError("stopped")

    query = changes.writeStream.outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation", checkpoint).foreachBatch(fail).start()
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    assert run(spark, folders, "days") == batch(spark, raw, "days")
