"""Counts, means, squares and products of every two columns, in one scan.

A pair of columns uses the rows that have both values. With many columns that is one
aggregate buffer too many for generated code, and a scan per handful of pairs. Here a
task keeps a state of a few square matrices, whose updates are matrix products over a
batch of rows, and hands over one row per pair. States are merged by the formula of
parallel variance, around a mean that one of them has, so neither large means nor
the number of tasks cost digits, and a column that is constant on a pair's rows has a
square sum of exactly zero.

The functions inside ``_task_states`` travel to the tasks by value: executors need
numpy and pyarrow, not this package.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nan_to_null

_STATE = (
    "i int, j int, n long, mean_i double, mean_j double, square_i double, square_j double, product double"
)


def _task_states(width: int) -> Callable:
    """mapInArrow function: one row per pair ``i <= j`` of ``width`` columns.

    In a state ``mean[i, j]`` and ``square[i, j]`` belong to column ``i`` on the rows
    that have both ``i`` and ``j``.
    """

    def of_rows(values, present):
        n = present.T.astype(float) @ present
        held = np.where(present, values, 0.0)
        # any value of the column will do; the middle one is not far out
        centre = np.array([
            np.partition(c[p], p.sum() // 2)[p.sum() // 2] if p.any() else 0.0
            for c, p in zip(held.T, present.T)
        ])
        held = np.where(present, held - centre, 0.0)
        mask = present.astype(float)
        total, squares, products = held.T @ mask, (held * held).T @ mask, held.T @ held
        some = np.maximum(n, 1)
        mean = centre[:, None] + total / some
        square = squares - total * total / some
        product = products - total * total.T / some
        # a pair's rows may lie far from the centre, close to each other: sum around their mean
        close = np.triu((square < 1e-6 * squares) | (square < 1e-6 * squares).T)
        for i, j in zip(*np.nonzero(close)):
            both = present[:, i] & present[:, j]
            x, y = (values[both, k] for k in (i, j))
            a, b = (v[0] if v.min() == v.max() else v.mean() for v in (x, y))
            mean[i, j], mean[j, i] = a, b
            square[i, j], square[j, i] = ((x - a) ** 2).sum(), ((y - b) ** 2).sum()
            product[i, j] = product[j, i] = ((x - a) * (y - b)).sum()
        return n, mean, square, product

    def merged(a, b):
        n = a[0] + b[0]
        some = np.maximum(n, 1)
        apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        both = a[0] * b[0] / some
        mean = np.where(a[0] > 0, a[1], b[1]) + apart * b[0] / some
        return n, mean, a[2] + b[2] + apart * apart * both, a[3] + b[3] + apart * apart.T * both

    def states(batches):
        state = None
        for batch in batches:
            values = np.empty((batch.num_rows, width))
            for i in range(width):
                values[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            if batch.num_rows:
                found = of_rows(values, ~np.isnan(values))
                state = found if state is None else merged(state, found)
        if state is not None:
            n, mean, square, product = state
            i, j = np.nonzero(np.triu(n))
            yield pa.RecordBatch.from_arrays([
                pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j].astype(np.int64)),
                *(pa.array(a) for a in (mean[i, j], mean[j, i], square[i, j], square[j, i], product[i, j])),
            ], names=["i", "j", "n", "mean_i", "mean_j", "square_i", "square_j", "product"])

    return states


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, n, square_i, square_j, product)`` of the pairs ``i <= j`` that share rows.

    ``square`` and ``product`` are sums around the means; ``i`` and ``j`` are positions
    in ``columns``. NaN is a missing value.
    """
    values = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    states = values.mapInArrow(_task_states(len(columns)), _STATE)
    pair = Window.partitionBy("i", "j")

    def from_common(mean: str) -> Column:
        return F.col(mean) - F.max_by(mean, "n").over(pair)

    moved = states.withColumns({"a": from_common("mean_i"), "b": from_common("mean_j")})
    n = F.col("n")
    sums = moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("a")).alias("a"), F.sum(n * F.col("b")).alias("b"),
        F.sum(F.col("square_i") + n * F.col("a") * F.col("a")).alias("square_i"),
        F.sum(F.col("square_j") + n * F.col("b") * F.col("b")).alias("square_j"),
        F.sum(F.col("product") + n * F.col("a") * F.col("b")).alias("product"),
    )
    return sums.select(
        "i", "j", "n",
        (F.col("square_i") - F.col("a") * F.col("a") / n).alias("square_i"),
        (F.col("square_j") - F.col("b") * F.col("b") / n).alias("square_j"),
        (F.col("product") - F.col("a") * F.col("b") / n).alias("product"),
    )


def pearson() -> Column:
    """Correlation from the sums of :func:`comoments`; NULL where a column is constant."""
    both = F.col("square_i") * F.col("square_j")
    # one root is exact where the answer is; two are needed where the product is out of range
    scale = F.when((both > 0) & (both < float("inf")), F.sqrt(both)).otherwise(F.sqrt("square_i") * F.sqrt("square_j"))
    r = F.col("product") / scale
    defined = (F.col("square_i") > 0) & (F.col("square_j") > 0)
    return F.when(defined, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
