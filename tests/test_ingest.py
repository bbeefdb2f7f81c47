"""Raw files that arrive in several drops."""

from __future__ import annotations

import os
import sys

import pytest

from sondeflow.plans import ingest, manifest, materialize
from sondeflow.sources import read_clean_parquet

from frames import raw_frame

MODULE = sys.modules["sondeflow.plans.ingest"]


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = a.select(*columns), b.select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def files_of(path):
    return {
        f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


@pytest.fixture
def drops(tmp_path):
    """A year of readings; the second drop has every seventh reading of two months."""
    frame = raw_frame(2000, hours=4)
    late = frame["Timestamp"].str[:7].isin(["2021-06", "2021-07"]) & (frame.index % 7 == 0)
    raw = tmp_path / "raw"
    raw.mkdir()
    frame[~late].to_csv(raw / "first.csv", index=False)

    def second():
        frame[late].to_csv(raw / "second.csv", index=False)

    return str(raw), second, str(tmp_path / "clean"), str(tmp_path / "whole")


def test_a_second_drop_rewrites_the_months_it_touches(spark, drops):
    raw, second, clean, whole = drops
    ingest(spark, raw, clean, view=None)
    before = files_of(clean)
    second()
    table = ingest(spark, raw, clean, view=None)
    after = files_of(clean)
    same(table, materialize(spark, raw, whole, view=None))
    changed = {f for f in before if before[f] != after.get(f)}
    assert changed and all("month=6" in f or "month=7" in f for f in changed)
    assert {f for f in after if f not in before} and all("month=6" in f or "month=7" in f for f in set(after) - set(before))
    assert {os.path.basename(r["file"]) for r in manifest(spark, clean).collect()} == {"first.csv", "second.csv"}


def test_a_rerun_changes_nothing(spark, drops):
    raw, _, clean, _ = drops
    ingest(spark, raw, clean, view=None)
    before = files_of(clean)
    assert ingest(spark, raw, clean, view=None).count() == read_clean_parquet(spark, clean).count()
    assert files_of(clean) == before


def test_a_failed_drop_leaves_the_table(spark, drops):
    raw, second, clean, _ = drops
    ingest(spark, raw, clean, view=None)
    before = files_of(clean)
    second()
    with open(f"{raw}/third.csv", "w") as bad, open(f"{raw}/first.csv") as good:
        bad.writelines(good.readlines()[:5])  # record numbers that are there already
    with pytest.raises(AssertionError, match="key_unique"):
        ingest(spark, raw, clean, view=None)
    assert files_of(clean) == before and manifest(spark, clean).count() == 1
    os.remove(f"{raw}/third.csv")
    assert ingest(spark, raw, clean, view=None).count() == 2000


@pytest.mark.parametrize("step", ["write_clean_parquet", "_delete"])
def test_an_interrupted_drop_is_finished(spark, drops, monkeypatch, step):
    """The run stops before the months are replaced, or after that and before it is tidied up."""
    raw, second, clean, whole = drops
    ingest(spark, raw, clean, view=None)
    second()
    apply, real = MODULE._apply, getattr(MODULE, step)

    def stopped(*args):
        def fail(*a, **k):
            raise OSError("stopped")

        monkeypatch.setattr(MODULE, step, fail)
        apply(*args)

    monkeypatch.setattr(MODULE, "_apply", stopped)
    with pytest.raises(OSError, match="stopped"):
        ingest(spark, raw, clean, view=None)
    monkeypatch.setattr(MODULE, "_apply", apply)
    monkeypatch.setattr(MODULE, step, real)
    same(ingest(spark, raw, clean, view=None), materialize(spark, raw, whole, view=None))
    assert manifest(spark, clean).count() == 2


def test_a_changed_file_is_refused(spark, drops):
    raw, _, clean, _ = drops
    ingest(spark, raw, clean, view=None)
    with open(f"{raw}/first.csv", "a") as file:
        file.write("2021-06-01 00:00:01,99999" + "," * 18 + "\n")
    with pytest.raises(Exception, match="changed after it was added"):
        ingest(spark, raw, clean, view=None)


def test_part_of_a_year(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    raw_frame(60, hours=4).to_csv(tmp_path / "raw" / "a.csv", index=False)
    with pytest.raises(AssertionError, match="seasons_complete"):
        ingest(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), view=None)
    assert ingest(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), view=None, part_year=True).count() == 60
