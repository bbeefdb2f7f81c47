"""Tables of readings derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondeflow.functions import steady_mean
from sondeflow.operators.cleaning import add_time_features
from sondeflow.session import configure

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# Stated, not inferred: reading footers for a schema is a job of its own.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                " l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns of a test table that the catalog uses."""
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events averaged per ten minutes and type: five measures with real gaps."""
    events = table(spark, sf_dir, "events")
    slots = events.groupBy(F.window("ts", "10 minutes")["start"].alias("timestamp")).agg(*[
        steady_mean(F.when(F.col("event_type") == t, F.col("value")), 2).alias(t)
        for t in EVENT_TYPES
    ])
    return add_time_features(slots)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one irregular series with a single measure."""
    events = table(spark, sf_dir, "events")
    return add_time_features(events.select(
        F.col("event_id").alias("record_number"), F.col("ts").alias("timestamp"), "value"
    ))


def long_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as seven years of readings with repeated record numbers."""
    lines = table(spark, sf_dir, "lineitem")
    return add_time_features(lines.select(
        F.col("l_orderkey").alias("record_number"),
        F.col("l_shipdate").alias("timestamp"),
        "l_linenumber", *LINE_MEASURES,
    ))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings with unique record numbers and some days missing."""
    table_ = table(spark, sf_dir, "orders")
    return add_time_features(table_.select(
        F.col("o_orderkey").alias("record_number"),
        F.col("o_orderdate").alias("timestamp"),
        "o_totalprice",
    ))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a window from its time on, ten seconds for each unit of its value."""
    seconds = (F.floor("value") * 10).cast("decimal(18,6)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event"), F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("end"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of the raw CSV; they pass the acceptance checks."""
    table_ = table(spark, sf_dir, "orders")
    return table_.select(
        F.col("o_orderdate").cast("string").alias("Timestamp"),
        F.col("o_orderkey").alias("Record number"),
        F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")).alias("Turbidity"),
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of the raw CSV: text under the raw headers."""
    events = table(spark, sf_dir, "events")
    value = F.col("value").cast("string")
    return events.select(
        F.col("ts").cast("string").alias("Timestamp"),
        F.col("event_id").cast("string").alias("Record number"),
        F.when(F.col("event_type") == "error", F.lit("NaN")).otherwise(value).alias("Temperature"),
        F.when(F.col("event_type") == "view", value).alias("Turbidity"),
        F.col("user_id").cast("string").alias("Temperature [quality]"),
        F.col("event_type").alias("Station note"),
    )


#: Orders whose line is spoilt: a field too few, one too many, a quote left open.
SPOILT_EVERY = 97


def write_raw_lines(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Orders as raw CSV, in two drops, with some lines that do not fit the header.

    Lines are written as they are: one column whose name is the whole header, no quoting.
    """
    fields = [F.col(c).cast("string") for c in ("o_orderdate", "o_orderkey", "o_totalprice")]
    kind = F.col("o_orderkey") % SPOILT_EVERY
    line = (
        F.when(kind == 0, F.concat_ws(",", *fields[:2]))
        .when(kind == 1, F.concat_ws(",", *fields, F.lit("again")))
        .when(kind == 2, F.concat(F.lit('"'), F.concat_ws(",", *fields)))
        .otherwise(F.concat_ws(",", *fields))
    )
    for drop in (0, 1):
        table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == drop).select(
            line.alias("Timestamp,Record number,Turbidity")
        ).write.options(header=True, sep="\u0001", quote="\u0000", escapeQuotes=False).csv(f"{folder}/drop={drop}")
