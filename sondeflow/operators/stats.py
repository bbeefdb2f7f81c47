"""Descriptive statistics, spread, outliers, histograms and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nan_to_null, one_row_per_column, ratio, rounded, steady_mean
from .comoments import comoments, pearson
from .quantiles import (
    QUARTILES,
    exact_quantiles,
    group_table,
    long_values,
    named,
    sketched_quantiles,
    with_group,
)


def _quartiles(df: DataFrame, columns: Sequence[str], by: Sequence[str], exact: bool) -> DataFrame:
    find = exact_quantiles if exact else sketched_quantiles
    return find(df, columns, QUARTILES, by)


def _is_float(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("float", "double")


def describe_measures(
    df: DataFrame,
    columns: Sequence[str],
    digits: int | None = 2,
    resolution: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum, missing %.

    One row per column. NaN is a missing value here as everywhere. Quartiles
    interpolate linearly; ``exact=False`` takes them from a one-scan sketch.
    """
    df = df.select([nan_to_null(c).alias(c) if c in columns and _is_float(df, c) else c for c in df.columns])
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[steady_mean(c, resolution).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    )
    moments = one_row_per_column(wide, "parameter", {
        c: {
            "count": F.col(f"{c}_n"),
            "mean": F.col(f"{c}_mean"),
            "std": F.col(f"{c}_std"),
            "min": F.col(f"{c}_min").cast("double"),
            "max": F.col(f"{c}_max").cast("double"),
            "missing_pct": ratio(
                F.lit(100.0) * (F.col("__rows") - F.col(f"{c}_n")), F.col("__rows")
            ),
        }
        for c in columns
    })
    quartiles = _quartiles(df, columns, (), exact).drop("n")
    r = lambda name: rounded(F.col(name), digits)
    return moments.join(F.broadcast(quartiles), "parameter", "left").select(
        "parameter", "count", r("mean").alias("mean"), r("std").alias("std"),
        r("min").alias("min"), r("q0").alias("q25"), r("q1").alias("q50"),
        r("q2").alias("q75"), r("max").alias("max"), r("missing_pct").alias("missing_pct"),
    )


def coefficient_of_variation(
    df: DataFrame, columns: Sequence[str], digits: int | None = None
) -> DataFrame:
    """Sample deviation over the absolute mean, most variable first.

    A mean of zero gives NULL.
    """
    wide = df.agg(*[
        ratio(F.stddev_samp(nan_to_null(c)), F.abs(F.avg(nan_to_null(c)))).alias(c) for c in columns
    ])
    return one_row_per_column(
        wide, "parameter", {c: {"cv": rounded(F.col(c), digits)} for c in columns}
    ).orderBy(F.col("cv").desc(), "parameter")


def _fences(quartiles: DataFrame) -> DataFrame:
    spread = F.col("q2") - F.col("q0")
    return quartiles.withColumns({
        "lower_fence": F.col("q0") - spread * 1.5,
        "upper_fence": F.col("q2") + spread * 1.5,
    })


def box_stats(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    digits: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """Quartiles, whiskers and outlier count per column and group.

    A whisker ends at the last value within one and a half interquartile ranges,
    and never inside the box.
    """
    keys = [*by, "position"]
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("parameter"))
    fences = _fences(_quartiles(df, columns, by, exact)).withColumn(
        "position", (place - 1).cast("int")
    ).drop("parameter")
    fences, small = group_table(fences, bounded=not by)
    value = F.col("value")
    inside = value.between(F.col("lower_fence"), F.col("upper_fence"))
    r = lambda c: rounded(c, digits)
    boxes = (
        with_group(long_values(df, columns, by), fences, keys, "n", small)
        .groupBy(*keys)
        .agg(
            F.max("n").alias("count"),
            *[F.max(q).alias(q) for q in ("q0", "q1", "q2")],
            F.min(F.when(inside, value)).alias("low"),
            F.max(F.when(inside, value)).alias("high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return named(boxes, columns, by).select(
        *by, "parameter", "count",
        r(F.least("low", "q0")).alias("whisker_low"),
        r(F.col("q0")).alias("q25"), r(F.col("q1")).alias("q50"), r(F.col("q2")).alias("q75"),
        r(F.greatest("high", "q2")).alias("whisker_high"),
        "outliers",
    )


def iqr_outlier_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Values beyond one and a half interquartile ranges, most outliers first.

    Columns without any value count none.
    """
    found = box_stats(df, columns, exact=exact).select("parameter", "outliers")
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("parameter")
    )
    return (
        names.join(F.broadcast(found), "parameter", "left")
        .select("parameter", F.coalesce("outliers", F.lit(0).cast("bigint")).alias("iqr_outlier_count"))
        .orderBy(F.col("iqr_outlier_count").desc(), "parameter")
    )


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 40, digits: int | None = None
) -> DataFrame:
    """Equal-width histogram of each column between its minimum and maximum.

    Bins are half open except the last. All bins are present, empty ones too. A
    constant column gets a range of one around its value.
    """
    values = long_values(df, columns)
    extent = values.groupBy("position").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    flat = F.col("min") == F.col("max")
    extent = extent.select(
        "position",
        F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("low"),
        F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / bins)

    def edge(number: Column) -> Column:
        return F.when(number == bins, F.col("high")).otherwise(F.col("low") + number * F.col("width"))

    # One row per listed column, and later one per listed column and bin.
    extent = F.broadcast(extent)
    value = F.col("value")
    guess = F.least(F.floor((value - F.col("low")) / F.col("width")), F.lit(bins - 1))
    # Rounding can put a value on the wrong side of an edge; the edge decides.
    number = (
        F.when(value < edge(guess), guess - 1)
        .when((guess < bins - 1) & (value >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = (
        values.join(extent, "position")
        .groupBy("position", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = extent.withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
    )
    filled = all_bins.join(F.broadcast(counts), ["position", "bin"], "left").select(
        "position", "bin",
        rounded(edge(F.col("bin")), digits).alias("bin_from"),
        rounded(edge(F.col("bin") + 1), digits).alias("bin_to"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("readings"),
    )
    return named(filled, columns).orderBy("parameter", "bin")


def _correlations(df: DataFrame, columns: Sequence[str], mirrored: bool) -> DataFrame:
    """Correlations in long form, from one scan whatever the number of columns."""
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, r double")
    found = comoments(df, columns).select("i", "j", pearson().alias("r"))
    if mirrored:
        own, turned = F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r")
        found = found.select(F.inline(F.when(F.col("i") < F.col("j"), F.array(own, turned)).otherwise(F.array(own))))
    # one row per listed pair, also where no row has both values
    last = len(columns) - 1
    pairs = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j")
    ).where(F.lit(True) if mirrored else F.col("i") < F.col("j"))
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.join(F.broadcast(found), ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"),
        F.when(F.col("i") == F.col("j"), F.when(F.col("r").isNotNull(), F.lit(1.0))).otherwise(F.col("r")).alias("r"),
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], digits: int | None = None
) -> DataFrame:
    """Pearson correlation of every pair of columns, in column order.

    Each pair uses the rows that have both values.
    """
    return _correlations(df, columns, False).withColumn("r", rounded(F.col("r"), digits))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], digits: int | None = None
) -> DataFrame:
    """The full symmetric matrix in long form; the diagonal is 1 where defined.

    Fewer than two columns have no matrix: no rows.
    """
    return _correlations(df, columns, True).withColumn("r", rounded(F.col("r"), digits))


def strongest_correlation(
    df: DataFrame, columns: Sequence[str], digits: int | None = None
) -> DataFrame:
    """The pair with the largest absolute correlation, with its sign.

    Ties go to the earlier pair; without a defined correlation there is no row.
    """
    position = {
        side: F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(side))
        for side in ("column_a", "column_b")
    }
    return (
        correlation_pairs(df, columns)
        .where(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), position["column_a"], position["column_b"])
        .limit(1)
        .withColumn("r", rounded(F.col("r"), digits))
    )


def reproducible_sample(
    df: DataFrame,
    size: int = 3000,
    key: Sequence[str] = ("record_number",),
    seed: int = 42,
    digest: str = "xxhash64",
) -> DataFrame:
    """Random sample of exactly ``min(size, rows)`` rows.

    Rows are ordered by a digest of key and seed, so the sample is the same for
    every partitioning. Only rows below a digest threshold take part: about half as
    many again as asked for, whatever the number of tasks. The threshold follows from
    the number of rows, which is counted first, and is raised while it lets too few
    pass (keys that repeat share a digest).
    ``digest="md5"`` is slower and picks rows that other engines can pick too.
    """
    if digest == "md5":
        order = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
        limit = lambda share: F.lit(f"{int(share * (1 << 128)):032x}")
    else:
        order = F.xxhash64(*key, F.lit(seed))
        limit = lambda share: F.lit(int(share * (1 << 64)) - (1 << 63))
    total = df.count()
    wanted, share = min(size, total), 1.0
    if total > 4 * size:
        share = (1.5 * size + 100) / total
        while share < 1 and df.where(order < limit(share)).limit(wanted).count() < wanted:
            share *= 4
    rest = [c for c in df.columns if c not in key]
    picked = df.where(order < limit(share)) if share < 1 else df
    return picked.orderBy(order, *key, *rest).limit(size)
