"""Exact quantiles of large columns, without sorting or collecting them.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a
first scan takes a mergeable rank sketch of every column, which tells two values that
enclose each wanted rank up to its known error. A second scan counts: the readings
between the enclosed ranges, and inside a range the readings of each value. Those are
about a few thousandths of the readings, and a partial aggregate, so a value that fills a
third of the table is one count per task. The counts show whether every wanted rank
was enclosed (if not, wider ranges are counted), and a range that holds more values
than one window should is cut into pieces before its values are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nan_to_null, one_row_per_column
from ..scale import attach, fits_broadcast, materialized, spread_join

QUARTILES = (0.25, 0.5, 0.75)

#: A sketch is off by one part in so many of the ranks.
ACCURACY = 10_000

#: Errors of the sketch to either side of a wanted rank; the last range is everything.
SLACKS = (2, 200, ACCURACY)

#: Different values that are numbered in one window, and pieces that more are cut into.
HELD = 1 << 16
PIECES = 64


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-missing values as ``(*by, position, value)``, one row each.

    Columns go by their position: joining and grouping every value by a name
    takes several times as long as by an integer.
    """
    entries = [
        F.struct(F.lit(i).alias("position"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(columns)
    ]
    return df.select(*by, F.inline(F.array(*entries))).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def named(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Put the column's name as ``parameter`` in the place of its position."""
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("position"))
    rest = [c for c in df.columns if c not in by and c != "position"]
    return df.select(*by, name.alias("parameter"), *rest)


def group_table(groups: DataFrame, bounded: bool) -> tuple[DataFrame, bool]:
    """A per-group table, and whether it may be broadcast.

    A table that is bounded by construction passes as it is. The size of any
    other is known only from the data: compute it once and measure it.
    """
    if bounded:
        return groups, True
    groups = materialized(groups)
    return groups, fits_broadcast(groups)


def with_group(
    values: DataFrame, groups: DataFrame, keys: list[str], weight: str, small: bool
) -> DataFrame:
    """Put the columns of a per-group table next to every value of the group."""
    if small:
        return attach(values, groups, keys, null_keys=True, broadcast=True)
    return spread_join(values, groups, keys, weight, null_keys=True)


def _intervals(probabilities: Sequence[float], slack: int) -> list[tuple[float, float]]:
    """Ranges of probability around the wanted ones, ascending and apart from each other."""
    found: list[tuple[float, float]] = []
    for p in sorted({float(p) for p in probabilities}):
        low, high = max(0.0, p - slack / ACCURACY), min(1.0, p + slack / ACCURACY)
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def _part(value: Column, bounds: Column | list, intervals: Sequence[tuple[float, float]]) -> Column:
    """Number of the part that a value lies in: odd inside a range, even between two."""
    part = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, (low, high) in enumerate(intervals):
        if low > 0:
            part = part.when(value < bounds[2 * k], 2 * k)
        if high == 1:
            return part.otherwise(2 * k + 1)
        part = part.when(value <= bounds[2 * k + 1], 2 * k + 1)
    return part.otherwise(2 * len(intervals))


def _cells(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], intervals: Sequence[tuple[float, float]]
) -> DataFrame:
    """``(*by, position, path, value, n)``: readings per value in a range, or between ranges.

    Two scans: the sketches, one wide aggregate, and the counts.
    """
    values = {f"__v{i}": nan_to_null(F.col(c).cast("double")) for i, c in enumerate(columns)}
    wide = df.select(*by, *[v.alias(name) for name, v in values.items()])
    edges = [p for pair in intervals for p in pair]
    sketches = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[
        F.percentile_approx(name, edges, ACCURACY).alias(f"__b{i}") for i, name in enumerate(values)
    ])
    if by:
        sketches, small = group_table(sketches, bounded=False)
        wide = with_group(wide, sketches, list(by), "__n", small)
        bounds = [F.col(f"__b{i}") for i in range(len(columns))]
    else:
        # one row: so many numbers for each listed column
        found = sketches.first()
        bounds = [[F.lit(b) for b in found[f"__b{i}"] or [None] * len(edges)] for i in range(len(columns))]
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.col(name).alias("value"),
            _part(F.col(name), bounds[i], intervals).alias("part"),
        )
        for i, name in enumerate(values)
    ]
    long = wide.select(*by, F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    inside = F.when(F.col("part") % 2 == 1, F.col("value"))
    counted = long.groupBy(*by, "position", "part", inside.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "position", F.array("part").alias("path"), "value", "n")


def _sides(total: Column, probabilities: Sequence[float]) -> list[tuple[Column, Column]]:
    """For each quantile the zero-based ranks on either side of its position."""
    at = [F.lit(float(p)) * (total - 1) for p in probabilities]
    return [(F.floor(a), F.ceil(a)) for a in at]


def _holds(rank: Column) -> Column:
    return (rank >= F.col("below")) & (rank < F.col("upto"))


def _wanted(cells: DataFrame, keys: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Parts that hold a wanted rank: ``below`` as many readings, with ``different`` values."""
    order = Window.partitionBy(*keys).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    parts = cells.groupBy(*keys, "path").agg(
        F.sum("n").alias("held"), F.count("value").alias("different")
    ).select(
        *keys, "path", "different", F.sum("held").over(order).alias("upto"),
        (F.sum("held").over(order) - F.col("held")).alias("below"),
        F.sum("held").over(Window.partitionBy(*keys)).alias("total"),
    )
    ranks = [r for pair in _sides(F.col("total"), probabilities) for r in pair]
    return parts.where(reduce(lambda a, b: a | b, map(_holds, ranks))).drop("upto")


def _cut(cells: DataFrame, overfull: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the overfull parts in pieces of about as many different values each."""
    place = [*keys, "path"]
    shares = [k / PIECES for k in range(1, PIECES)]
    cuts = attach(cells, overfull.select(*place), place, "left_semi", null_keys=True).groupBy(*place).agg(
        F.percentile_approx("value", shares, 100 * PIECES).alias("cuts")
    )
    piece = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    finer = F.when(F.col("cuts").isNull(), F.col("path")).otherwise(F.concat("path", F.array(piece)))
    return attach(cells, materialized(cuts), place, "left", null_keys=True).select(
        *keys, finer.alias("path"), "value", "n"
    )


def _enclosed(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The cells, and the parts of them that hold a wanted rank and few enough values."""
    keys = [*by, "position"]
    for slack in SLACKS:
        cells = materialized(_cells(df, columns, by, _intervals(probabilities, slack)))
        while True:
            wanted = _wanted(cells, keys, probabilities)
            least, most = wanted.agg(F.min("different"), F.max("different")).first()
            if least == 0 or (most or 0) <= HELD:
                break
            cells = materialized(_cut(cells, wanted.where(F.col("different") > HELD), keys))
        if least != 0:
            break
    return cells, wanted


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Quantiles with linear interpolation, per column and group.

    One row per ``(*by, parameter)`` that has values, with the number of values
    as ``n`` and the quantiles as ``q0, q1, ...`` in the order asked for.
    """
    keys = [*by, "position"]
    cells, wanted = _enclosed(df, columns, probabilities, by)
    running = Window.partitionBy(*keys, "path").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        attach(cells, wanted, [*keys, "path"], null_keys=True)
        .withColumn("upto", F.col("below") + F.sum("n").over(running))
        .withColumn("below", F.col("upto") - F.col("n"))
    )
    quantiles, share = [], []
    for i, (lower, upper) in enumerate(_sides(F.col("total"), probabilities)):
        quantiles += [
            F.max(F.when(_holds(lower), F.col("value"))).alias(f"a{i}"),
            F.max(F.when(_holds(upper), F.col("value"))).alias(f"b{i}"),
        ]
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("n") - 1)
        share.append(at - F.floor(at))
    found = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *quantiles)
    return named(found, columns, by).select(*by, "parameter", "n", *[
        F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}"))
        .otherwise(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * s).alias(f"q{i}")
        for i, s in enumerate(share)
    ])


def sketched_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Approximate quantiles from one scan, same shape as the exact ones."""
    wide = df.groupBy(*by).agg(
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[
            F.percentile_approx(c, list(map(float, probabilities)), accuracy).alias(f"{c}_q")
            for c in columns
        ],
    )
    return one_row_per_column(wide, "parameter", {
        c: {
            "n": F.col(f"{c}_n"),
            **{f"q{i}": F.col(f"{c}_q")[i].cast("double") for i in range(len(probabilities))},
        }
        for c in columns
    }, keep=by).where(F.col("n") > 0)
