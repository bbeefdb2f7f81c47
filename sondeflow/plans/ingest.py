"""Adding raw files to a cleaned table, month by month.

A manifest beside the table lists the files that are in it. A drop of new files is
cleaned, the months it touches are put together with what the table holds of them, and
Spark's dynamic overwrite replaces these months and no other. Everything is prepared in
a folder beside the table and checked there; its list of files, written last, says that
it is complete. A run that fails before leaves the table as it was, and what it prepared
is thrown away by the next one; a run that fails later is finished by the next one,
which can overwrite the same months again and again. So every file counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import clean
from ..operators.quality import assert_clean
from ..session import configure
from ..sources import read_clean_parquet, read_raw_csv, register_view, write_clean_parquet
from .materialize import located

_MANIFEST = "file string, length long, modified timestamp"
_MONTH = ("year", "month")


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = located(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = located(spark, path)
    files.delete(place, True)


def manifest(spark: SparkSession, clean_path: str) -> DataFrame:
    """``(file, length, modified)`` of the raw files that are in the table."""
    path = f"{clean_path.rstrip('/')}.manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(path).distinct()


def new_files(spark: SparkSession, raw_path: str, clean_path: str) -> DataFrame:
    """``(file, length, modified)`` of the raw files that are not in the table yet.

    A file that was changed after it was added raises: its old rows are in the table.
    """
    listed = spark.read.format("binaryFile").load(raw_path).select(
        F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")
    )
    known = manifest(spark, clean_path).select(
        "file", F.col("length").alias("__length"), F.col("modified").alias("__modified")
    )
    both = listed.join(known, "file", "left")
    changed = (F.col("length") != F.col("__length")) | (F.col("modified") != F.col("__modified"))
    told = F.raise_error(F.concat(F.lit("changed after it was added: "), F.col("file")))
    return both.where(F.col("__length").isNull() | changed).select(
        F.when(F.col("__length").isNull(), F.col("file")).otherwise(told).alias("file"), "length", "modified"
    )


def _prepare(
    spark: SparkSession, found: DataFrame, clean_path: str, pending: str, southern: bool, skip: tuple[str, ...]
) -> None:
    """The months that the new files touch, as they will be, checked with the rest of the table."""
    paths = [r["file"] for r in found.select("file").collect()]
    write_clean_parquet(clean(read_raw_csv(spark, paths), southern), f"{pending}/new")
    fresh = read_clean_parquet(spark, f"{pending}/new")
    touched = F.broadcast(fresh.select(*_MONTH).distinct())  # a row per month
    rest, total = None, fresh.count()
    if _exists(spark, clean_path):
        table = read_clean_parquet(spark, clean_path)
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in _MONTH]
        months = table.alias("t").join(touched.alias("m"), same[0] & same[1], "left_semi")
        rest = table.alias("t").join(touched.alias("m"), same[0] & same[1], "left_anti")
        fresh, total = fresh.unionByName(months), total + table.count()
    write_clean_parquet(fresh, f"{pending}/table")
    after = read_clean_parquet(spark, f"{pending}/table")
    assert_clean(after if rest is None else after.unionByName(rest), total, skip=skip)
    found.write.parquet(f"{pending}/files")


def _apply(spark: SparkSession, clean_path: str, pending: str) -> None:
    write_clean_parquet(read_clean_parquet(spark, f"{pending}/table"), clean_path, only_months=True)
    spark.read.parquet(f"{pending}/files").write.mode("append").parquet(f"{clean_path.rstrip('/')}.manifest")
    _delete(spark, pending)


def ingest(
    spark: SparkSession,
    raw_path: str,
    clean_path: str,
    southern: bool = True,
    view: str | None = "water_quality",
    part_year: bool = False,
) -> DataFrame:
    """The cleaned table with all raw files under ``raw_path``, each added once.

    ``part_year`` accepts a table in which seasons are missing. One run at a time: runs
    that overlap would prepare the same months.
    """
    configure(spark)
    pending = f"{clean_path.rstrip('/')}.pending"
    if _exists(spark, f"{pending}/files/_SUCCESS"):
        _apply(spark, clean_path, pending)
    else:
        _delete(spark, pending)
    # written once: a file that arrives while this runs is the next run's
    new_files(spark, raw_path, clean_path).write.parquet(f"{pending}/found")
    found = spark.read.schema(_MANIFEST).parquet(f"{pending}/found")
    if found.isEmpty():
        _delete(spark, pending)
    else:
        _prepare(spark, found, clean_path, pending, southern, ("seasons_complete",) if part_year else ())
        _apply(spark, clean_path, pending)
    table = read_clean_parquet(spark, clean_path)
    if view:
        register_view(table, view)
    return table
