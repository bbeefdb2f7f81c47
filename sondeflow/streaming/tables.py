"""Daily means and repeated timestamps as streams over raw files.

A run takes the files that have come since the last one, brings its state up to date and
stops. Changed rows go to a folder of their own per batch, which a repeated batch
overwrites; the last one of each key counts. So a run that fails in any place is
finished by the next one from its checkpoint, and the table after several drops equals the one
made of all files at once. The watermark bounds the state: rows that come later than
``lateness`` behind the newest one are left out, and days and timestamps before it
are forgotten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import mean_of, rounded, steady_total
from ..operators.cleaning import clean
from ..schema import MISSING_TOKENS, RAW_TO_CLEAN

#: How long after the newest reading an older one may still come.
LATENESS = "7 days"


def raw_stream(spark: SparkSession, path: str, columns: Sequence[str] = tuple(RAW_TO_CLEAN)) -> DataFrame:
    """Cleaned readings of the raw CSV files with these headers, as they come."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    lines = (
        spark.readStream.schema(schema)
        .options(header=True, enforceSchema=False, columnPruning=False, mode="FAILFAST", escape='"')
        .csv(path)
    )
    return clean(lines.select(*[
        F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns
    ]))


def _once(readings: DataFrame, key: str, timestamp_column: str, lateness: str) -> DataFrame:
    """Each reading once: rows that repeat the key within the watermark are the same one."""
    return readings.withWatermark(timestamp_column, lateness).dropDuplicatesWithinWatermark([key])


def daily_means(
    readings: DataFrame, column: str, resolution: int, key: str = "record_number",
    timestamp_column: str = "timestamp", lateness: str = LATENESS, digits: int | None = None,
) -> DataFrame:
    """``(date, value)`` of the days with readings; repeated rows count once."""
    kept = _once(readings, key, timestamp_column, lateness).where(F.col(column).isNotNull())
    days = kept.groupBy(F.window(timestamp_column, "1 day").alias("day")).agg(
        steady_total(column, resolution).alias("total"), F.count(F.lit(1)).alias("n")
    )
    return days.select(
        F.to_date("day.start").alias("date"), rounded(mean_of(F.col("total"), F.col("n"), resolution), digits).alias("value")
    )


def repeated_timestamps(
    readings: DataFrame, timestamp_column: str = "timestamp", lateness: str = LATENESS
) -> DataFrame:
    """``(timestamp, occurrences)`` of the times that several rows share."""
    return (
        readings.withWatermark(timestamp_column, lateness).groupBy(timestamp_column)
        .agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    )


def update(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Add what has come since the last run to the table of changes below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        changes.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(write).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """The table that the changes below ``path`` have led to: the last row of each key."""
    changes = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")
