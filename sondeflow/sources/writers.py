"""Writers and SQL registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_clean_parquet(
    df: DataFrame,
    path: str,
    rebalance: bool = True,
    rows_per_file: int = 50_000_000,
    only_months: bool = False,
) -> None:
    """Overwrite ``path`` with Parquet laid out by year and month.

    ``only_months`` overwrites the months that ``df`` has and leaves the others.

    ``rebalance`` groups rows by month first, so that a task does not write to every
    month; the adaptive planner splits large months over several tasks. Readings
    that arrive in time order do without: a task then holds one or two months. Rows
    are in time order inside a file, so a time filter skips row groups.
    """
    if rebalance:
        df = df.hint("rebalance", F.col("year"), F.col("month"))
    (
        df.sortWithinPartitions("year", "month", "timestamp")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic" if only_months else "static")
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_clean_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with CSV files that carry a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def register_view(df: DataFrame, name: str = "water_quality") -> None:
    """Make ``df`` available to ``spark.sql`` for this session."""
    df.createOrReplaceTempView(name)


def save_table(
    df: DataFrame, name: str = "water_quality", bucket_by: str | None = None, buckets: int = 200, **options: str
) -> None:
    """Replace the catalog table ``name``.

    ``bucket_by`` stores it by a hash of that column, each bucket sorted in one file:
    counting, checking and joining by the column then moves no readings.
    """
    if bucket_by is None:
        df.write.mode("overwrite").options(**options).saveAsTable(name)
        return
    dealt = df.repartition(buckets, bucket_by)
    dealt.write.mode("overwrite").options(**options).bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(name)
