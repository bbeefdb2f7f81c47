from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sondeflow.plans import materialize
from sondeflow.operators import cleaning, overview
from sondeflow.sources import (
    read_clean_csv,
    read_clean_parquet,
    read_raw_csv,
    register_view,
    save_table,
    write_clean_csv,
    write_clean_parquet,
)

from frames import FIRST, ROWS, raw_frame, rows


@pytest.fixture
def raw_csv(tmp_path):
    path = str(tmp_path / "raw.csv")
    raw_frame(2000, hours=4).to_csv(path, index=False)
    return path


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = a.select(*columns), b.select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_missing_path_is_named(spark, tmp_path):
    path = str(tmp_path / "nothing.csv")
    with pytest.raises(FileNotFoundError, match="nothing.csv"):
        read_raw_csv(spark, path)


def test_every_spelling_of_missing_is_null(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Timestamp,Record number,pH\n" + "".join(
        f"2024-01-01 00:00:00,{i},{token}\n"
        for i, token in enumerate(["NA", "NaN", "null", "N/A", "", "7.5", "-nan", "None"])
    ))
    cleaned = cleaning.clean(read_raw_csv(spark, str(path)))
    assert dict(cleaned.dtypes)["ph"] == "double"
    assert dict(cleaned.dtypes)["record_number"] == "bigint"
    assert rows(cleaned.where("ph is not null").select("record_number", "ph")) == [(5, 7.5)]


def test_text_in_a_measure_raises_or_becomes_null(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Timestamp,Record number,pH\n2024-01-01 00:00:00,1,broken\n")
    raw = read_raw_csv(spark, str(path))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.clean(raw).collect()
    assert cleaning.clean(raw, malformed="null").first()["ph"] is None


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("Timestamp,pH\n2024-01-01 00:00:00,7\n")
    (tmp_path / "raw" / "b.csv").write_text("pH,Timestamp\n7,2024-01-01 00:00:00\n")
    with pytest.raises(Exception, match="header"):
        read_raw_csv(spark, str(tmp_path / "raw")).collect()


def test_parquet_round_trip(spark, clean, tmp_path):
    path = str(tmp_path / "clean")
    write_clean_parquet(clean, path)
    write_clean_parquet(clean, path, rebalance=True)
    back = read_clean_parquet(spark, path)
    same(back, clean)
    assert os.path.isdir(f"{path}/year=2021/month=7")


def test_csv_round_trip_restores_types(spark, clean, tmp_path):
    path = str(tmp_path / "clean_csv")
    write_clean_csv(clean, path)
    back = read_clean_csv(spark, path)
    assert dict(back.dtypes) == dict(clean.dtypes)
    same(back, clean)


def test_materialize_builds_once(spark, raw_csv, tmp_path):
    path = str(tmp_path / "out" / "clean")
    first = materialize(spark, raw_csv, path)
    assert first.count() == 2000
    os.remove(raw_csv)
    assert materialize(spark, raw_csv, path).count() == 2000
    assert spark.sql("select count(distinct season) from water_quality").first()[0] == 4


def test_materialize_rebuilds_a_half_written_table(spark, raw_csv, tmp_path):
    path = tmp_path / "clean"
    materialize(spark, raw_csv, str(path))
    (path / "_SUCCESS").unlink()
    for file in list(path.rglob("*.parquet"))[1:]:
        file.unlink()
    assert materialize(spark, raw_csv, str(path)).count() == 2000
    assert [f.name for f in tmp_path.iterdir() if "building" in f.name] == []


def test_unordered_input_is_not_scattered(spark, tmp_path):
    frame = raw_frame(2000, hours=4).sample(frac=1, random_state=1)
    for i in range(8):
        frame.iloc[i::8].to_csv(tmp_path / f"raw{i}.csv", index=False)
    path = tmp_path / "out"
    assert materialize(spark, str(tmp_path / "raw*.csv"), str(path), view=None).count() == 2000
    months = {f.parent for f in path.rglob("*.parquet")}
    assert len(list(path.rglob("*.parquet"))) <= 2 * len(months)


def test_materialize_refuses_a_bad_table(spark, tmp_path):
    frame = raw_frame(2000, hours=4)
    frame["Record number"] = 0
    frame.to_csv(tmp_path / "raw.csv", index=False)
    path = str(tmp_path / "clean")
    with pytest.raises(AssertionError, match="key_unique"):
        materialize(spark, str(tmp_path / "raw.csv"), path)
    assert not os.path.exists(path)


def test_view_and_table(spark, clean):
    register_view(clean, "readings_view")
    register_view(clean.limit(5), "readings_view")
    assert spark.sql("select count(*) from readings_view").first()[0] == 5
    save_table(clean, "readings_table")
    save_table(clean.limit(7), "readings_table")
    assert spark.table("readings_table").count() == 7


def test_first_and_last_rows(clean):
    assert [r["record_number"] for r in overview.first_rows(clean).collect()] == list(range(FIRST, FIRST + 5))
    assert [r["record_number"] for r in overview.last_rows(clean, 2).collect()] == [FIRST + ROWS - 1, FIRST + ROWS - 2]


def test_overview(clean):
    holes = clean.withColumn("ph", F.when(F.col("record_number") < FIRST + 90, F.col("ph")))
    found = {r["column"]: r for r in overview.table_overview(holes).collect()}
    assert len(found) == 26
    assert (found["ph"]["dtype"], found["ph"]["total_rows"], found["ph"]["non_null"]) == ("double", ROWS, 90)


SPOILT = ["2024-01-01 00:00:00,2", "2024-01-01 00:00:00,3,7.0,8.0", '"2024-01-01 00:00:00,4,7.0', "2024-01-01,\"5,7"]


@pytest.fixture
def spoilt(tmp_path):
    """Two files of readings of a year, four lines of which do not fit the header."""
    good = [f"2024-{m:02d}-01 00:00:00,{100 + m},{m / 2}" for m in range(1, 13)]
    quoted = ['"2024-02-02 00:00:00","200","7.25"', "2024-02-03 00:00:00,201,"]
    (tmp_path / "raw").mkdir()
    for name, lines in (("a", good[:6] + SPOILT[:3]), ("b", SPOILT[3:] + good[6:] + quoted)):
        (tmp_path / "raw" / f"{name}.csv").write_text("\n".join(["Timestamp,Record number,pH", *lines]) + "\n")
    return str(tmp_path / "raw")


def test_a_line_that_does_not_fit_raises(spark, spoilt, tmp_path):
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_raw_csv(spark, spoilt).select("pH").collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        materialize(spark, spoilt, str(tmp_path / "clean"))
    assert not os.path.exists(tmp_path / "clean")


def test_lines_that_do_not_fit_are_set_aside(spark, spoilt, tmp_path):
    clean, rejects = str(tmp_path / "clean"), str(tmp_path / "rejects")
    table = materialize(spark, spoilt, clean, rejects_path=rejects)
    assert sorted(r[0] for r in table.select("record_number").collect()) == [*range(101, 113), 200, 201]
    assert table.where("record_number = 200").first()["ph"] == 7.25
    found = {(r["file"].rsplit("/")[-1], r["text"]) for r in spark.read.parquet(rejects).collect()}
    assert found == {("a.csv", t) for t in SPOILT[:3]} | {("b.csv", SPOILT[3])}


def test_more_rejects_than_allowed_leave_no_table(spark, spoilt, tmp_path):
    clean = str(tmp_path / "clean")
    with pytest.raises(AssertionError, match="rows_rejected"):
        materialize(spark, spoilt, clean, rejects_path=str(tmp_path / "rejects"), most_rejected=3)
    assert not os.path.exists(clean)
    materialize(spark, spoilt, clean, rejects_path=str(tmp_path / "rejects"), most_rejected=4)


def test_without_rejects_their_table_is_empty(spark, raw_csv, tmp_path):
    rejects = str(tmp_path / "rejects")
    assert materialize(spark, raw_csv, str(tmp_path / "clean"), rejects_path=rejects).count() == 2000
    found = spark.read.parquet(rejects)
    assert found.columns == ["file", "text"] and found.count() == 0
