"""Raw CSV to validated, cleaned Parquet."""

from __future__ import annotations

import argparse
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.cleaning import clean
from ..operators.quality import assert_clean
from ..session import configure, session
from ..sources import (
    accepted,
    read_clean_parquet,
    read_raw_csv,
    read_raw_lines,
    register_view,
    rejects,
    write_clean_parquet,
)
from ..sources.readers import REJECTED


def located(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it names it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, if a writer has finished it: the marker is written last."""
    files, marker = located(spark, f"{path}/_SUCCESS")
    return read_clean_parquet(spark, path) if files.exists(marker) else None


def build(
    spark: SparkSession, raw_path: str, clean_path: str, southern: bool = True,
    rebalance: bool = True, malformed: str = "raise",
    rejects_path: str | None = None, most_rejected: int | None = None,
) -> None:
    """Write the cleaned table next to its place, check it, and move it there.

    The raw rows are read once and counted as they pass. The gate reads the written
    Parquet. A table that fails it is removed, and ``AssertionError`` names the
    failed checks; a half-written one in the place is replaced.

    A line that does not fit the header stops the build, unless ``rejects_path`` names a
    table for such lines: they are counted in the same pass, and only if there are any
    a second one writes them, with the file that each comes from.
    """
    staging = f"{clean_path.rstrip('/')}.building-{uuid4().hex}"
    files, staged = located(spark, staging)
    seen = Observation("raw readings")
    facts = [F.count(F.lit(1)).alias("rows")]
    if rejects_path:
        lines = read_raw_lines(spark, raw_path)
        raw = accepted(lines.observe(seen, *facts, F.count(REJECTED).alias("rejected")))
    else:
        raw = read_raw_csv(spark, raw_path).observe(seen, *facts)
    try:
        write_clean_parquet(clean(raw, southern, malformed), staging, rebalance)
        total, rejected = seen.get["rows"], seen.get.get("rejected")
        assert_clean(
            read_clean_parquet(spark, staging), total, rejected_rows=rejected, most_rejected=most_rejected
        )
        if rejected is not None:
            set_aside = rejects(lines) if rejected else rejects(lines).limit(0)
            set_aside.write.mode("overwrite").parquet(rejects_path)
        _, place = located(spark, clean_path)
        files.delete(place, True)
        if not files.rename(staged, place):
            raise OSError(f"{staging} could not be moved to {clean_path}")
    finally:
        files.delete(staged, True)


def materialize(
    spark: SparkSession,
    raw_path: str,
    clean_path: str,
    southern: bool = True,
    rebalance: bool = True,
    view: str | None = "water_quality",
    rejects_path: str | None = None,
    most_rejected: int | None = None,
) -> DataFrame:
    """The cleaned table, built from the raw file if it is not there yet."""
    configure(spark)
    if _existing(spark, clean_path) is None:
        build(
            spark, raw_path, clean_path, southern, rebalance,
            rejects_path=rejects_path, most_rejected=most_rejected,
        )
    table = read_clean_parquet(spark, clean_path)
    if view:
        register_view(table, view)
    return table


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("raw_path")
    parser.add_argument("clean_path")
    parser.add_argument("--ordered", action="store_true", help="raw files are in time order already")
    parser.add_argument("--rejects", help="table for lines that do not fit the header")
    options = parser.parse_args()
    spark = session("materialize readings")
    try:
        materialize(
            spark, options.raw_path, options.clean_path, rebalance=not options.ordered,
            rejects_path=options.rejects,
        )
    finally:
        spark.stop()
