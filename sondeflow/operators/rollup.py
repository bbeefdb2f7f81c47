"""A store of hourly states, from which calendar summaries are read.

A state holds what can be added up: readings, and per measure the number of values, their
exact total in steps of the resolution, the least and the greatest, and how many meet
each named condition. Each load writes the states of its own readings as a delta; a load
that is repeated replaces its delta, and late readings are just another one. A summary
adds the deltas' states up to days, months, seasons or hours of the day and equals the
one made from all readings, at the cost of hours instead of readings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import mean_of, ordinal, ratio, rounded, season_of, steady_total, weekday_name
from ..schema import SEASONS, WEEKDAYS

#: An hour of a calendar day; missing for readings without a time.
HOUR = ("year", "month", "day", "hour")


class Rollup:
    """What the states of a table hold: its measures, their decimals, named conditions."""

    def __init__(self, columns: Sequence[str], resolution: int, conditions: Mapping[str, str] | None = None):
        self.columns, self.resolution = list(columns), resolution
        self.conditions = dict(conditions or {})

    def _merged(self, counted: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
        sums = ["readings", *(f"{c}_n" for c in self.columns), *self.conditions]
        return counted.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in sums],
            *[F.sum(f"{c}_total").cast("decimal(38,0)").alias(f"{c}_total") for c in self.columns],
            *[F.min(f"{c}_min").alias(f"{c}_min") for c in self.columns],
            *[F.max(f"{c}_max").alias(f"{c}_max") for c in self.columns],
        )

    def states(self, df: DataFrame) -> DataFrame:
        """The hourly states of some readings: one partial aggregate."""
        values: list[Column] = [F.count(F.lit(1)).alias("readings")]
        for c in self.columns:
            values += [
                F.count(c).alias(f"{c}_n"), steady_total(c, self.resolution).alias(f"{c}_total"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
            ]
        values += [F.count_if(F.expr(sql)).alias(name) for name, sql in self.conditions.items()]
        return df.groupBy(*HOUR).agg(*values)

    def load(self, df: DataFrame, path: str, delta: str) -> None:
        """Write the states of the readings of one load below ``path``, in place of its former ones."""
        self.states(df).write.mode("overwrite").parquet(f"{path}/delta={delta}")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """The states of all loads, one row per hour."""
        return self._merged(spark.read.parquet(path).drop("delta"), HOUR)

    def compact(self, spark: SparkSession, path: str, new_path: str) -> None:
        """Write all deltas as a single one of a new store."""
        self.read(spark, path).write.mode("overwrite").parquet(f"{new_path}/delta=0")

    def _mean(self, c: str, digits: int | None) -> Column:
        return rounded(mean_of(F.col(f"{c}_total"), F.col(f"{c}_n"), self.resolution), digits)

    def _means(self, columns: Sequence[str], digits: int | None) -> list[Column]:
        return [self._mean(c, digits).alias(f"{c}_mean") for c in columns]

    def _by(self, store: DataFrame, name: str, key: Column, columns: Sequence[str], digits: int | None) -> DataFrame:
        found = self._merged(store, [key.alias(name)])
        return found.select(name, F.col("readings").alias("reading_count"), *self._means(columns, digits))

    def monthly_coverage(self, store: DataFrame) -> DataFrame:
        """As :func:`.temporal.monthly_coverage`."""
        return store.groupBy("year", "month").agg(
            F.sum("readings").alias("reading_count"),
            F.coalesce(
                F.bit_count(F.bit_or(F.expr("shiftleft(1L, day)"))).cast("long"), F.lit(0).cast("long")
            ).alias("distinct_days_with_readings"),
        ).orderBy("year", "month")

    def monthly_summary(self, store: DataFrame, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
        """As :func:`.temporal.monthly_summary`."""
        found = self._merged(store, ["year", "month"])
        statistics = []
        for c in columns:
            statistics += [
                self._mean(c, digits).alias(f"{c}_mean"),
                rounded(F.col(f"{c}_min"), digits).alias(f"{c}_min"), rounded(F.col(f"{c}_max"), digits).alias(f"{c}_max"),
            ]
        return found.select("year", "month", *statistics).orderBy("year", "month")

    def seasonal_summary(
        self, store: DataFrame, columns: Sequence[str], digits: int | None = 2, southern: bool = True
    ) -> DataFrame:
        """As :func:`.temporal.seasonal_summary`."""
        season = season_of(F.col("month"), southern)
        return self._by(store, "season", season, columns, digits).orderBy(ordinal("season", SEASONS))

    def weekday_summary(self, store: DataFrame, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
        """As :func:`.temporal.weekday_summary`."""
        day = weekday_name(F.make_date("year", "month", "day"))
        return self._by(store, "day_of_week", day, columns, digits).orderBy(ordinal("day_of_week", WEEKDAYS))

    def hourly_cycle(self, store: DataFrame, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
        """As :func:`.temporal.hourly_cycle`."""
        return self._by(store, "hour", F.col("hour"), columns, digits).orderBy("hour")

    def condition_by_month(self, store: DataFrame, condition: str, name: str = "high_readings") -> DataFrame:
        """As :func:`.conditions.readings_above_by_month`, for a condition of the store."""
        found = store.groupBy("year", "month").agg(F.sum(condition).alias(name))
        return found.where(F.col(name) > 0).orderBy("year", "month")

    def hours_summary_by_season(
        self, store: DataFrame, column: str, first_hour: int = 6, before_hour: int = 18, digits: int | None = 3,
        southern: bool = True,
    ) -> DataFrame:
        """As :func:`.conditions.hours_summary_by` for seasons."""
        kept = store.where((F.col("hour") >= first_hour) & (F.col("hour") < before_hour) & (F.col(f"{column}_n") > 0))
        found = self._merged(kept, [season_of(F.col("month"), southern).alias("season")])
        return found.select(
            "season", F.col(f"{column}_n").alias("reading_count"), self._mean(column, digits).alias("mean"),
            rounded(F.col(f"{column}_min"), digits).alias("min"), rounded(F.col(f"{column}_max"), digits).alias("max"),
        ).orderBy(F.desc("mean"), "season")

    def condition_share_by_season(
        self, store: DataFrame, column: str, condition: str, digits: int | None = 2, southern: bool = True
    ) -> DataFrame:
        """As :func:`.conditions.atypical_share` for seasons and a condition of the store."""
        kept = store.where(F.col(f"{column}_n") > 0)
        found = kept.groupBy(season_of(F.col("month"), southern).alias("season")).agg(
            F.sum(f"{column}_n").alias("total_readings"), F.sum(condition).alias("atypical_readings")
        )
        share = ratio(F.lit(100.0) * F.col("atypical_readings"), F.col("total_readings"))
        return found.withColumn("atypical_pct", rounded(share, digits)).orderBy(F.desc("atypical_pct"), "season")
