"""One entry per operator: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sondeflow import streaming
from sondeflow.functions import as_category, ordinal
from sondeflow.functions.sql import create_band_function, register_functions
from sondeflow.operators import (
    anomaly,
    cleaning,
    conditions,
    duplicates,
    filters,
    gaps,
    missingness,
    overview,
    quality,
    rollup,
    series,
    stats,
    temporal,
    windows,
)
from sondeflow.plans import ingest, materialize
from sondeflow.schema import SEASONS, WEEKDAYS, RangeRule
from sondeflow.session import ensure_checkpoint_dir
from sondeflow.sources import readers, writers

from .views import (
    EVENT_TYPES,
    LINE_MEASURES,
    event_table,
    long_range,
    orders,
    raw_orders,
    raw_readings,
    readings,
    table,
    wide,
    write_raw_lines,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

VALUE_BANDS = [(10.0, "low"), (35.0, "moderate"), (70.0, "good"), (None, "high")]
QUANTITY_BANDS = [(10.0, "small"), (30.0, "medium"), (None, "large")]
LINE_RULES = [
    RangeRule("quantity_outside", ("l_quantity",), low=2, high=49),
    RangeRule("discount_high", ("l_discount",), high=0.09),
    RangeRule("negative_values", ("l_quantity", "l_tax", "no_such_column"), low=0),
    RangeRule("absent_measure", ("no_such_column",), low=0),
]
WINDOWS = [
    ("2024-01-10 00:00:00", "2024-01-14 00:00:00", "first event"),
    ("2024-01-20 00:00:00", "2024-01-21 00:00:00", "second event"),
]
#: SQL of ten measures of a line item, each missing for some orders.
TEN_MEASURES = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_extendedprice * (1 + l_tax)", "l_linenumber",
    "l_extendedprice * l_discount", "l_quantity * (1 - l_tax)", "l_extendedprice / l_quantity",
]
LINE_KEY = ["record_number", "l_linenumber"]


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which every engine prints alike."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def query(view: Callable[[SparkSession, str], DataFrame]):
    """Register a function of one view under its own name."""

    def register(operator: Callable[[DataFrame], DataFrame]):
        QUERIES[operator.__name__] = lambda spark, sf_dir: iso_dates(operator(view(spark, sf_dir)))
        return operator

    return register


# first looks

@query(readings)
def row_count(df):
    return overview.row_count(df)


@query(long_range)
def filtered_row_count(df):
    return overview.filtered_row_count(df, filters.selected(["Summer", "Winter"]))


@query(readings)
def extent(df):
    return overview.extent(df)


@query(wide)
def table_overview(df):
    return overview.table_overview(df.select("timestamp", *EVENT_TYPES, "day_of_week"))


@query(readings)
def first_readings(df):
    return overview.first_rows(df.select("record_number", "timestamp", "value"))


@query(readings)
def last_readings(df):
    return overview.last_rows(df.select("record_number", "timestamp", "value"))


@query(long_range)
def distinct_seasons(df):
    return overview.distinct_values(df, "season")


@query(long_range)
def distinct_weekdays(df):
    return overview.distinct_values(df, "day_of_week")


@query(long_range)
def distinct_year_months(df):
    return overview.distinct_values(df, "year", "month")


# cleaning and projections

@query(raw_readings)
def clean_readings(df):
    cleaned = cleaning.clean(df)
    return cleaned.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(readings)
def chronological_readings(df):
    return cleaning.chronological(df.select("record_number", "timestamp", "value"))


_ORDER_COLUMNS = (
    "record_number", "turbidity", "year", "month", "day", "hour", "day_of_week", "season",
)


def _order_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *_ORDER_COLUMNS)


def _new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/catalog-{uuid4().hex}"


def _materialized(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Raw CSV to validated Parquet, under a view of its own."""
    view = f"water_quality_{uuid4().hex}"
    raw_orders(spark, sf_dir).write.option("header", True).csv(f"{folder}/raw")
    materialize(spark, f"{folder}/raw", f"{folder}/clean", view=view)
    return view


def materialized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV to validated Parquet to SQL."""
    return _order_rows(spark.sql(f"SELECT * FROM {_materialized(spark, sf_dir, _new_folder(spark))}"))


def materialized_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is there already, and the raw files are not looked at."""
    folder = _new_folder(spark)
    _materialized(spark, sf_dir, folder)
    return _order_rows(materialize(spark, f"{folder}/nowhere", f"{folder}/clean", view=None))


def clean_csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned readings to CSV and back, with their types."""
    folder = _new_folder(spark)
    writers.write_clean_csv(cleaning.clean(raw_orders(spark, sf_dir)), folder)
    return _order_rows(readers.read_clean_csv(spark, folder))


def saved_table_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned readings as a catalog table."""
    name = f"orders_{uuid4().hex}"
    writers.save_table(cleaning.clean(raw_orders(spark, sf_dir)), name, path=_new_folder(spark))
    return _order_rows(spark.table(name))


def _with_rejects(spark: SparkSession, sf_dir: str) -> str:
    """Raw lines, some of them spoilt, to a clean table and a table of rejects."""
    folder = _new_folder(spark)
    write_raw_lines(spark, sf_dir, f"{folder}/raw")
    materialize(spark, f"{folder}/raw/*", f"{folder}/clean", view=None, rejects_path=f"{folder}/rejects")
    return folder


def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not fit the header, with the drop that they came in."""
    rejects = readers.read_clean_parquet(spark, f"{_with_rejects(spark, sf_dir)}/rejects")
    return rejects.select(F.regexp_extract("file", "drop=([0-9]+)", 1).cast("int").alias("drop"), "text")


def materialized_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that do fit, cleaned."""
    return _order_rows(readers.read_clean_parquet(spark, f"{_with_rejects(spark, sf_dir)}/clean"))


def clean_gate_report_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a table whose rejects are set aside; more of them than allowed."""
    folder = _new_folder(spark)
    write_raw_lines(spark, sf_dir, folder)
    lines = readers.read_raw_lines(spark, f"{folder}/*")
    return quality.gate_report(
        cleaning.clean(readers.accepted(lines)), lines.count(),
        rejected_rows=readers.rejects(lines).count(), most_rejected=3,
    )


def ingested_in_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV in two drops that share all months, and a run without new files."""
    folder = _new_folder(spark)
    for drop in (0, 1):
        rows = raw_orders(spark, sf_dir).where(F.col("Record number") % 3 % 2 == drop)
        rows.write.option("header", True).csv(f"{folder}/raw/{drop}")
        ingest(spark, f"{folder}/raw/*", f"{folder}/clean", view=None)
    return _order_rows(ingest(spark, f"{folder}/raw/*", f"{folder}/clean", view=None))


def streamed_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV in three drops, one after the other in time, each a run of the stream."""
    folder = _new_folder(spark)
    for drop in range(3):
        rows = raw_orders(spark, sf_dir)
        month = F.substring("Timestamp", 1, 4).cast("int") * 12 + F.substring("Timestamp", 6, 2).cast("int")
        rows.where(F.least(F.greatest(F.floor((month - 23904) / 27), F.lit(0)), F.lit(2)) == drop).write.option(
            "header", True).csv(f"{folder}/raw/{drop}")
        readings_ = streaming.raw_stream(spark, f"{folder}/raw/*", ["Timestamp", "Record number", "Turbidity"])
        changes = streaming.daily_means(readings_, "turbidity", 2, digits=2)
        streaming.update(changes, f"{folder}/days", f"{folder}/progress")
    return iso_dates(streaming.latest(spark, f"{folder}/days", ["date"], changes.schema))


QUERIES["ingested_in_drops"] = ingested_in_drops
QUERIES["streamed_daily_means"] = streamed_daily_means
QUERIES["quarantined_rows"] = quarantined_rows
QUERIES["materialized_with_rejects"] = materialized_with_rejects
QUERIES["clean_gate_report_rejects"] = clean_gate_report_rejects
def _bucketed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows from a table that is stored by record number."""
    name = f"bucketed_{uuid4().hex}"
    writers.save_table(df, name, "record_number", 16, path=_new_folder(spark))
    return spark.table(name)


def bucketed_duplicate_id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a record number, from a table stored by it."""
    lines = long_range(spark, sf_dir).where("l_linenumber > 5").select(*LINE_KEY, "timestamp", "l_extendedprice")
    return duplicates.duplicate_key_rows(_bucketed(spark, lines), "record_number")


def clean_gate_report_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a table stored by record number."""
    return quality.gate_report(_bucketed(spark, orders(spark, sf_dir)), table(spark, sf_dir, "orders").count())


QUERIES["bucketed_duplicate_id_rows"] = bucketed_duplicate_id_rows
QUERIES["clean_gate_report_bucketed"] = clean_gate_report_bucketed
QUERIES["materialized_again"] = materialized_again
QUERIES["clean_csv_orders"] = clean_csv_orders
QUERIES["saved_table_orders"] = saved_table_orders
QUERIES["materialized_orders"] = materialized_orders


@query(readings)
def time_features(df):
    return df


@query(long_range)
def time_features_long_range(df):
    return df.select(*LINE_KEY, "timestamp", "year", "month", "day", "hour", "day_of_week", "season")


@query(long_range)
def ordered_categories(df):
    working_day = as_category("day_of_week", WEEKDAYS[:5])
    return (
        df.groupBy("season", working_day.alias("working_day"))
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .withColumn("season_position", ordinal("season", SEASONS))
        .withColumn("day_position", F.coalesce(ordinal("working_day", WEEKDAYS), F.lit(0)))
    )


@query(wide)
def present_measures(df):
    return cleaning.select_measures(df, [*EVENT_TYPES, "no_such_measure"])


# filters

@query(long_range)
def selected_seasons(df):
    return filters.in_seasons(df, ["Autumn", "Spring"]).select(*LINE_KEY, "season", "l_quantity")


@query(wide)
def rows_with_values(df):
    return filters.with_values(df, "purchase").select("timestamp", "purchase")


@query(readings)
def event_readings(df):
    start, end, _ = WINDOWS[0]
    return filters.between_times(
        df, start, end, year_column="year", month_column="month"
    ).select("record_number", "timestamp", "value")


@query(readings)
def event_readings_whole_days(df):
    start, end, _ = WINDOWS[1]
    return filters.between_times(df, start, end, whole_days=True).select(
        "record_number", "timestamp", "value"
    )


@query(readings)
def high_daytime_readings(df):
    return filters.between_hours(filters.above(df, "value", 60), 6, 18).select(
        "record_number", "hour", "value"
    )


@query(readings)
def annotate_events(df):
    days = temporal.daily_mean_calendar(df, "value", resolution=2)
    return filters.annotate_events(days, WINDOWS)


def annotate_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with the events of a table, those of a day with its own number of them."""
    days = temporal.daily_mean_calendar(readings(spark, sf_dir), "value", resolution=2)
    events = event_table(spark, sf_dir).where("event % 50 = 7").withColumnRenamed("event", "event_label")
    return iso_dates(filters.annotate_events(days, events))


def event_table_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings inside each of as many overlapping windows as there are events."""
    return conditions.event_table_means(
        readings(spark, sf_dir), ["value"], event_table(spark, sf_dir), digits=4, resolution=2
    )


QUERIES["annotate_event_table"] = annotate_event_table
QUERIES["event_table_means"] = event_table_means


# missing values

@query(wide)
def null_counts_wide(df):
    return missingness.null_counts(df, EVENT_TYPES)


@query(wide)
def missing_pct_long(df):
    return missingness.missingness_summary(df, EVENT_TYPES)


@query(wide)
def missing_all_columns(df):
    return missingness.missingness_summary(df, min_count=1)


@query(wide)
def missing_pct_by_period(df):
    return missingness.missing_pct_by(df, ["month", "day"], EVENT_TYPES)


@query(wide)
def missing_pct_by_month(df):
    return missingness.missing_pct_by_month(df, "click", digits=4)


@query(wide)
def missing_pct_filtered(df):
    return missingness.missing_pct(filters.between_hours(df, 6, 18), "click", digits=4)


@query(wide)
def all_missing_rows(df):
    return missingness.all_missing_rows(df, ["click", "view"])


# duplicates

@query(long_range)
def full_duplicate_rows(df):
    return duplicates.full_duplicates(df.select(*LINE_KEY))


@query(long_range)
def excess_duplicates(df):
    return duplicates.excess_rows(df.select(*LINE_KEY))


@query(long_range)
def excess_record_numbers(df):
    return duplicates.excess_rows(df, ["record_number"])


@query(long_range)
def excess_timestamps(df):
    return duplicates.excess_rows(df, ["timestamp"])


@query(long_range)
def duplicate_id_rows(df):
    return duplicates.duplicate_key_rows(df.select(*LINE_KEY, "timestamp", "l_extendedprice"), *LINE_KEY)


@query(long_range)
def duplicate_id_groups(df):
    return duplicates.repeated_keys(df, *LINE_KEY)


@query(long_range)
def top_repeated_timestamps(df):
    return duplicates.top_repeated(df, "timestamp", 10)


@query(long_range)
def rows_sharing_timestamp(df):
    return duplicates.rows_sharing(
        df, "timestamp", ["timestamp", *LINE_KEY, "l_extendedprice"],
        order=["timestamp", *LINE_KEY, "l_extendedprice"],
    )


# limits, gate, summary

@query(long_range)
def range_check_report(df):
    return quality.range_report(df, LINE_RULES)


@query(long_range)
def implausible_rows(df):
    return quality.implausible_rows(df, LINE_RULES)


QUERIES["negative_value_rows"] = lambda spark, sf_dir: quality.negative_rows(
    table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]
)


@query(long_range)
def min_max_ranges(df):
    return quality.measure_ranges(df, LINE_MEASURES)


def gate_query(name: str, cleaned: Callable[[SparkSession, str], DataFrame], raw: str) -> None:
    """The gate over a cleaned frame, against the row count of the raw table."""
    QUERIES[name] = lambda spark, sf_dir: quality.gate_report(
        cleaned(spark, sf_dir), table(spark, sf_dir, raw).count()
    )


gate_query("clean_gate_report", long_range, "lineitem")
gate_query("clean_gate_report_orders", orders, "orders")
gate_query(
    "clean_gate_report_lost_rows",
    lambda spark, sf_dir: long_range(spark, sf_dir).where("l_quantity > 1"), "lineitem",
)
gate_query(
    "clean_gate_report_untyped",
    lambda spark, sf_dir: orders(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string")), "orders",
)


@query(long_range)
def quality_summary(df):
    return quality.quality_summary(
        df.select(*LINE_KEY), df, raw_key="record_number", rules=LINE_RULES
    )


@query(long_range)
def quality_summary_removed(df):
    return quality.quality_summary(
        df.select(*LINE_KEY), df.where("l_quantity > 3"), raw_key="record_number", rules=LINE_RULES
    )


@query(long_range)
def duplicate_whole_rows(df):
    """Whole rows, of which a union has doubled some."""
    doubled = df.unionByName(df.where("l_linenumber = 3"))
    return duplicates.full_duplicates(doubled.select("record_number", "timestamp", "l_linenumber", *LINE_MEASURES))


@query(readings)
def gap_report_millisecond(df):
    return gaps.gap_report(df, 0.001).agg(
        F.count(F.lit(1)).alias("gaps"), F.max("gap_seconds").alias("longest"),
        F.max("gap_ends_at").alias("last_end"),
    )


# calendar aggregation

@query(long_range)
def monthly_coverage(df):
    return temporal.monthly_coverage(df)


@query(long_range)
def monthly_stats(df):
    return temporal.monthly_summary(df, ["l_quantity", "l_extendedprice", "l_tax"], resolution=2)


@query(long_range)
def monthly_means(df):
    return temporal.monthly_means(df, ["l_quantity", "l_discount"], digits=4, resolution=2)


@query(long_range)
def month_over_month(df):
    return temporal.month_over_month(df, "l_extendedprice", resolution=2)


@query(long_range)
def seasonal_summary(df):
    return temporal.seasonal_summary(df, LINE_MEASURES, resolution=2)


@query(long_range)
def weekday_summary(df):
    return temporal.weekday_summary(df, ["l_quantity", "l_extendedprice"], resolution=2)


@query(readings)
def hourly_cycle(df):
    return temporal.hourly_cycle(df, ["value"], resolution=2)


@query(long_range)
def daily_mean_present(df):
    return temporal.daily_mean(df, "l_extendedprice", digits=2, resolution=2)


@query(orders)
def daily_mean_calendar(df):
    return temporal.daily_mean_calendar(df, "o_totalprice", resolution=2)


@query(long_range)
def month_shape_normalised(df):
    return temporal.month_shape(df, LINE_MEASURES, resolution=2, digits=6)


ROLLUP = rollup.Rollup(LINE_MEASURES, 2, {
    "expensive": "l_extendedprice > 100000", "unusual": "l_quantity < 5 OR l_quantity > 45",
})


def rollup_query(name: str, report: Callable[[DataFrame], DataFrame]) -> None:
    """A summary from the hourly states of two loads, one of which is repeated."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, lines = _new_folder(spark), long_range(spark, sf_dir)
        for load, rows in (("early", "record_number % 7 > 0"), ("late", "l_linenumber = 1"), ("late", "record_number % 7 = 0")):
            ROLLUP.load(lines.where(rows), folder, load)
        return report(ROLLUP.read(spark, folder))

    QUERIES[name] = run


rollup_query("rollup_monthly_coverage", ROLLUP.monthly_coverage)
rollup_query("rollup_monthly_stats", lambda store: ROLLUP.monthly_summary(store, ["l_quantity", "l_extendedprice", "l_tax"]))
rollup_query("rollup_seasonal_summary", lambda store: ROLLUP.seasonal_summary(store, LINE_MEASURES))
rollup_query("rollup_weekday_summary", lambda store: ROLLUP.weekday_summary(store, ["l_quantity", "l_extendedprice"]))
rollup_query("rollup_threshold_by_month", lambda store: ROLLUP.condition_by_month(store, "expensive"))
rollup_query("rollup_atypical_share", lambda store: ROLLUP.condition_share_by_season(store, "l_quantity", "unusual"))


# conditions

@query(readings)
def band_counts(df):
    return conditions.band_counts(df, "value", VALUE_BANDS)


@query(long_range)
def season_band_counts(df):
    return conditions.band_counts_by(df, "season", "l_quantity", QUANTITY_BANDS)


@query(long_range)
def threshold_by_month(df):
    return conditions.readings_above_by_month(df, "l_extendedprice", 100000)


def sql_season_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands per season, in SQL with functions of this session."""
    view = f"long_range_{uuid4().hex}"
    writers.register_view(long_range(spark, sf_dir), view)
    register_functions(spark)
    create_band_function(spark, "quantity_band", QUANTITY_BANDS)
    return spark.sql(
        f"SELECT season_of(month) AS season, quantity_band(l_quantity) AS band, count(*) AS reading_count FROM {view}"
        " WHERE l_quantity IS NOT NULL GROUP BY ALL"
    )


QUERIES["sql_season_band_counts"] = sql_season_band_counts


@query(readings)
def daytime_stats_by_group(df):
    return conditions.hours_summary_by(df, "day_of_week", "value", 6, 18, resolution=2)


@query(long_range)
def months_above_global_mean(df):
    return conditions.months_above_overall_mean(df, "l_extendedprice", 1.005, resolution=2)


@query(long_range)
def low_days_with_enough_readings(df):
    return conditions.low_days(df, "l_quantity", 24, 3, resolution=2)


@query(long_range)
def atypical_share_by_season(df):
    return conditions.atypical_share(df, "season", "l_quantity", 5, 45)


@query(readings)
def event_window_mean(df):
    start, end, _ = WINDOWS[0]
    return conditions.event_means(df, ["value"], start, end, digits=4, resolution=2)


# statistics

@query(wide)
def describe_measures(df):
    return stats.describe_measures(df, EVENT_TYPES, digits=4)


@query(long_range)
def describe_long_range(df):
    return stats.describe_measures(df, LINE_MEASURES, digits=4, resolution=2)


@query(long_range)
def coefficient_of_variation(df):
    return stats.coefficient_of_variation(df, LINE_MEASURES, digits=6)


@query(readings)
def iqr_outlier_counts(df):
    return stats.iqr_outlier_counts(df, ["value"])


@query(wide)
def iqr_outlier_counts_wide(df):
    return stats.iqr_outlier_counts(df, EVENT_TYPES)


@query(readings)
def histogram_counts(df):
    return stats.histogram(df, ["value"], bins=40, digits=6)


@query(long_range)
def histogram_counts_long_range(df):
    return stats.histogram(df, ["l_extendedprice", "l_tax"], bins=60, digits=6)


@query(readings)
def box_stats(df):
    return stats.box_stats(df, ["value"], digits=4)


@query(long_range)
def box_stats_by_season(df):
    return stats.box_stats(df, ["l_quantity", "l_extendedprice"], by=["season"], digits=4)


@query(wide)
def correlation_pairs(df):
    return stats.correlation_pairs(df, EVENT_TYPES, digits=6)


def correlation_ten_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*[
        F.expr(f"CASE WHEN l_orderkey % 7 <> {i % 7} THEN CAST({x} AS DOUBLE) END").alias(f"m{i}")
        for i, x in enumerate(TEN_MEASURES)
    ])
    return stats.correlation_pairs(df, [f"m{i}" for i in range(10)], digits=6)


QUERIES["correlation_ten_measures"] = correlation_ten_measures


@query(long_range)
def correlation_matrix(df):
    return stats.correlation_matrix(df, LINE_MEASURES, digits=6)


@query(long_range)
def strongest_correlation(df):
    return stats.strongest_correlation(df, LINE_MEASURES, digits=6)


@query(readings)
def reproducible_sample(df):
    return stats.reproducible_sample(df.select("record_number", "timestamp", "value"), 3000, digest="md5")


@query(long_range)
def flagged_days_by_measure(df):
    flagged = anomaly.flagged_days(df, LINE_MEASURES, resolution=2)
    return anomaly.flagged_day_counts(flagged, LINE_MEASURES)


@query(long_range)
def most_flagged_days(df):
    flagged = anomaly.flagged_days(df, LINE_MEASURES, resolution=2)
    return anomaly.most_flagged_days(flagged, LINE_MEASURES)


# windows and series

@query(long_range)
def rolling_7(df):
    days = temporal.daily_mean(df, "l_extendedprice", digits=2, resolution=2)
    return windows.rolling_mean(days, 7, resolution=2)


_SERIES, _ORDER = ["series"], ["timestamp", *LINE_KEY, "l_extendedprice", "l_quantity"]


def _forty_series(df: DataFrame) -> DataFrame:
    """Line items as forty long series of readings."""
    return df.select((F.col("record_number") % 40).alias("series"), *_ORDER)


@query(long_range)
def moving_mean_of_readings(df):
    found = series.moving_mean(_forty_series(df), _SERIES, _ORDER, "l_extendedprice", 7)
    return found.select(*_SERIES, *_ORDER, "rolling_mean")


@query(long_range)
def running_mean_of_readings(df):
    found = series.running_mean(_forty_series(df), _SERIES, _ORDER, "l_quantity", digits=4)
    return found.select(*_SERIES, *_ORDER, "cumulative_mean")


@query(long_range)
def streaks_of_readings(df):
    return series.series_streaks(
        _forty_series(df), _SERIES, _ORDER, F.col("l_quantity") > 5, 20, "l_extendedprice", digits=2
    )


@query(long_range)
def cumulative_mean(df):
    return windows.cumulative_mean(
        temporal.daily_mean(df, "l_quantity", resolution=2), digits=4
    )


@query(long_range)
def rank_months(df):
    return windows.rank_months(df, "l_extendedprice", resolution=2)


@query(readings)
def deviation_from_day_mean(df):
    return windows.largest_deviations(df, "value", 15, resolution=2)


@query(readings)
def all_deviations(df):
    return windows.deviation_from_day(
        df.select("record_number", "timestamp", "value"), "value", digits=None, resolution=2
    )


@query(long_range)
def anomaly_days_high(df):
    return anomaly.high_days(temporal.daily_mean(df, "l_extendedprice", resolution=2))


@query(orders)
def anomaly_days_two_sided(df):
    days = temporal.daily_mean_calendar(df, "o_totalprice", resolution=2)
    return anomaly.flag_anomalous_days(days)


@query(wide)
def streaks_present_days(df):
    return anomaly.high_streaks(temporal.daily_mean(df, "click"), 50, digits=6)


@query(orders)
def streaks_calendar_days(df):
    days = temporal.daily_mean_calendar(df, "o_totalprice", resolution=2)
    return anomaly.find_streaks(
        days.withColumn("is_flagged", F.col("value") > 250000), value_column="value", digits=6
    )


@query(orders)
def streaks_broken_by_gaps(df):
    days = temporal.daily_mean(df, "o_totalprice", resolution=2)
    return anomaly.high_streaks(days, 250000, gap_breaks=True, digits=6)


@query(readings)
def sampling_intervals(df):
    return gaps.interval_counts(df, 10, unit_seconds=60)


@query(readings)
def sampling_intervals_exact(df):
    return gaps.interval_counts(df, None, unit_seconds=0.001)


@query(long_range)
def sampling_intervals_days(df):
    return gaps.interval_counts(df, None)


@query(readings)
def gap_report(df):
    return gaps.gap_report(df, 300)


@query(orders)
def gap_report_days(df):
    return gaps.gap_report(df, 86_400)


#: Queries that write tables of their own on the way, which takes most of their time.
WRITING = [
    "materialized_orders", "materialized_again", "clean_csv_orders", "saved_table_orders", "quarantined_rows",
    "materialized_with_rejects", "clean_gate_report_rejects", "bucketed_duplicate_id_rows", "clean_gate_report_bucketed",
    *(name for name in QUERIES if name.startswith("rollup_")), "streamed_daily_means", "ingested_in_drops",
]
