"""Whitening of embeddings: uncorrelated components of variance one.

Vectors are taken as whole numbers, so that counts, sums and the scatter around a whole
centre next to the mean are exact and the same for any partitioning. The scatter is a
sum of one small matrix per task. Its pivoted Cholesky factor is made orthogonal by
one-sided Jacobi rotations of its columns: the norms of the rotated columns are the
roots of the eigenvalues, the columns themselves, normalised, the components. The
factor is rotated directly, so no squared or inverted matrix loses digits, and a table
whose dimensions depend on each other yields as many components as it has.

Only distinct vectors are fitted to, however often one occurs. What the driver and each
task hold is bounded by the width of the vectors: a matrix of width by width.

Defined results: a row whose vector is missing or holds a missing or non-finite entry
is left out. Vectors of different widths are whitened apart, each width by its own fit;
an empty vector has no component. Entries beyond ``MOST`` steps count as that many.
Directions without variance are no components, so a single distinct vector yields no
row. Of equal eigenvalues any components may be returned. Repeated ids and rows are
returned each; a missing id stays missing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import saved

#: Steps to 1 and what is added to them.
SCALE, SHIFT = 64, 1_000_000

#: Largest size of an entry in steps.
MOST = 1 << 40

#: Whole numbers up to here are exact in a double.
_EXACT = 1 << 53

_BIG = pa.decimal128(38, 0)


class Centre(NamedTuple):
    """``n`` distinct vectors around the whole numbers ``at``, with sums ``rest`` from there."""

    n: int
    at: np.ndarray
    rest: np.ndarray


class Model(NamedTuple):
    centre: Centre
    #: A component per column, each divided by the root of its eigenvalue.
    scaled: np.ndarray
    explained: np.ndarray


def whole_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, x)`` of the rows whose vector is complete and finite."""
    c = F.col("c").cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))

    def steps(v):
        size = F.greatest(F.least(v * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))
        return F.floor(size).cast("long") + SHIFT

    narrow = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("c"))
    return narrow.where(F.col("c").isNotNull() & finite).select("id", F.transform(c, steps).alias("x"))


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of one width, and their vectors as a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        yield rows, values[starts[rows][:, None] + np.arange(width)]


def _big(values) -> pa.Array:
    """Whole numbers as decimals."""
    values = np.asarray(values)
    if values.dtype != object:
        return pa.array(values.astype(np.int64)).cast(_BIG)
    return pa.array([v if abs(v) < 10 ** 38 else None for v in map(int, values)], _BIG)


def scatter(vectors: np.ndarray) -> np.ndarray:
    """Sums of products of every two columns, exact, as int64 or Python numbers."""
    most = max(int(np.abs(vectors).max(initial=0)), 1)
    if len(vectors) * most * most >= 1 << 62:
        big = vectors.astype(object)
        return big.T @ big
    total = np.zeros((vectors.shape[1],) * 2, np.int64)
    step = _EXACT // (most * most)
    if not step:
        return vectors.T @ vectors
    for i in range(0, len(vectors), step):
        part = vectors[i:i + step].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def _listed(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """``(width, number, list of whole numbers)``"""
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0] + [len(r[2]) for r in rows]), pa.int32()),
        pa.concat_arrays([_big(r[2]) for r in rows]),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), lists],
        names=["width", "number", "part"],
    )


_PARTS = "width long, number long, part array<decimal(38,0)>"


def _centres(fit: DataFrame) -> dict[int, Centre]:
    """Number and sums of the vectors of each width: one row per task and width, added up."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in by_width(batch.column("x")):
                n, total = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = n + len(rows), total + x.sum(axis=0).astype(object)
        if found:
            yield _listed([(w, n, total) for w, (n, total) in found.items()])

    sums = (
        fit.mapInArrow(parts, _PARTS).select("width", "number", F.posexplode("part"))
        .groupBy("width", "pos").agg(F.sum("number").alias("n"), F.sum("col").alias("total"))
    )
    rows = sorted(sums.collect(), key=lambda r: (r["width"], r["pos"]))
    centres = {}
    for width in sorted({r["width"] for r in rows}):
        own = [r for r in rows if r["width"] == width]
        n, totals = own[0]["n"], [int(r["total"]) for r in own]
        at = [(2 * t + n) // (2 * n) for t in totals]
        rest = [t - n * a for t, a in zip(totals, at)]
        centres[width] = Centre(n, np.array(at, np.int64), np.array(rest, object))
    return centres


def _scatters(fit: DataFrame, centres: dict[int, Centre]) -> DataFrame:
    """``(width, i, line)``: the lines of each width's scatter around its centre."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_width(batch.column("x")):
                part = scatter(x - centres[x.shape[1]].at)
                part = part.astype(object) if x.shape[1] in found or part.dtype == object else part
                found[x.shape[1]] = found.get(x.shape[1], 0) + part
        for width, total in found.items():
            yield _listed([(width, i, line) for i, line in enumerate(total)])

    sums = (
        fit.mapInArrow(parts, _PARTS).select("width", "number", F.posexplode("part"))
        .groupBy("width", F.col("number").alias("i"), "pos").agg(F.sum("col").cast("double").alias("v"))
    )
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"])
    return sums.groupBy("width", "i").agg(line.alias("line"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``l`` with ``l @ l.T == a``: triangular up to the order of its lines, full column rank."""
    factor = np.zeros_like(a)
    left = a.diagonal().copy()
    limit = len(a) * np.finfo(float).eps * left.max(initial=0.0)
    done = np.zeros(len(a), bool)
    for k in range(len(a)):
        pivot = int(np.argmax(np.where(done, -1.0, left)))
        if done[pivot] or left[pivot] <= limit:
            return factor[:, :k]
        column = a[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        column[done] = 0.0
        root = np.sqrt(left[pivot])
        factor[:, k] = column / root
        factor[pivot, k] = root
        left -= factor[:, k] ** 2
        done[pivot] = True
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two of ``n`` columns once, in rounds of disjoint pairs."""
    ring = list(range(n)) + [-1] * (n % 2)
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1:-1]) if a >= 0 and b >= 0]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal."""
    columns = factor.copy()
    tolerance = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _rounds(columns.shape[1]):
            a, b = columns[:, p], columns[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > tolerance
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)) * turn
            c = 1 / np.hypot(1.0, t)
            columns[:, p], columns[:, q] = c * (a - t * b), c * (b + t * a)
        if worst <= tolerance:
            break
    return columns


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit components, one per column; ``most`` at most."""
    columns = rotated(pivoted_cholesky(covariance))
    values = (columns ** 2).sum(0)
    order = np.argsort(-values, kind="stable")[:most]
    units = columns[:, order] / np.sqrt(values[order])
    if units.size:
        largest = np.abs(units).argmax(axis=0)
        units = units * np.where(units[largest, np.arange(units.shape[1])] < 0, -1.0, 1.0)
    return values[order], units


def _models(lines: DataFrame, centres: dict[int, Centre], most: int) -> dict[int, Model]:
    """The fit of each width, by one task each; ``most`` columns of it come to the driver."""

    def fitted(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        order = np.argsort(table.column("i").to_numpy())
        total = np.array(table.column("line").combine_chunks().flatten()).reshape(-1, width)[order]
        n, _, rest = centres[width]
        drift = rest.astype(float) / n
        covariance = total / n - np.outer(drift, drift)
        values, units = principal_components(covariance, most)
        scaled = units / np.sqrt(values)
        return pa.table([
            pa.array(np.full(len(values), width)), pa.array(np.arange(len(values))),
            pa.array(values / np.trace(covariance)), pa.array(list(scaled.T), pa.list_(pa.float64())),
        ], names=["width", "component", "explained", "scaled"])

    schema = "width long, component long, explained double, scaled array<double>"
    found: dict[int, list] = {}
    for r in lines.groupBy("width").applyInArrow(fitted, schema).collect():
        found.setdefault(r["width"], []).append(r)
    models = {}
    for width, own in found.items():
        own.sort(key=lambda r: r["component"])
        models[width] = Model(
            centres[width], np.array([r["scaled"] for r in own]).T, np.array([r["explained"] for r in own])
        )
    return models


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    n, at, rest = model.centre
    return ((x - at) - rest.astype(float) / n) @ model.scaled


def _identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on all."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_width(batch.column("x")):
                if x.shape[1] in models:
                    w = whitened(x, models[x.shape[1]])
                    part = np.concatenate([w.sum(0), (w.T @ w).ravel()])
                    found[x.shape[1]] = found.get(x.shape[1], 0) + part
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found)), pa.array(list(found.values()), pa.list_(pa.float64()))],
                names=["width", "part"],
            )

    sums = (
        fit.mapInArrow(parts, "width long, part array<double>").select("width", F.posexplode("part"))
        .groupBy("width", "pos").agg(F.sum("col").alias("total"))
    )
    totals: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        totals.setdefault(r["width"], {})[r["pos"]] = r["total"]
    errors = {}
    for width, model in models.items():
        k, n = len(model.explained), model.centre.n
        flat = np.array([totals[width][i] for i in range(k + k * k)])
        mean = flat[:k] / n
        errors[width] = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return errors


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Squared distance from the mean times the squared number of vectors, exact."""
    y = x - centre.at
    most = centre.n * int(np.abs(y).max(initial=0)) + max(map(abs, centre.rest))
    if x.shape[1] * most * most < 1 << 63:
        return _big(((centre.n * y - centre.rest.astype(np.int64)) ** 2).sum(axis=1))
    far = centre.n * y.astype(object) - centre.rest
    return _big((far * far).sum(axis=1))


def whiten(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 16
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``.

    A row per vector and component, numbered from 1 by falling eigenvalue; ``n`` is the
    number of distinct vectors and ``deviation`` a whole number, NULL beyond 38 digits.
    """
    rows = whole_vectors(table, id_column, vector_column)
    fit = saved(rows.select("x").distinct(), "vectors")
    centres = _centres(fit)
    models = _models(_scatters(fit, centres), centres, components)
    models = {width: m for width, m in models.items() if len(m.explained)}
    errors = _identity_errors(fit, models)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for numbers, x in by_width(batch.column("x")):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                k, own = len(model.explained), np.repeat(np.arange(len(numbers)), len(model.explained))
                count = len(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(numbers[own])),
                    pa.array(np.tile(np.arange(1, k + 1), len(numbers)), pa.int32()),
                    pa.array(np.full(count, model.centre.n)),
                    _deviations(x, model.centre).take(pa.array(own)),
                    pa.array(whitened(x, model).ravel()),
                    pa.array(np.tile(model.explained, len(numbers))),
                    pa.array(np.full(count, errors[x.shape[1]])),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(batches, (
        f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    ))
