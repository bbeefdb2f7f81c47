"""Numeric expressions: missing values, safe ratios, rounding, means."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

# steady_total adds the low and high parts of each value separately, so that
# neither sum leaves the 64-bit range before 2**43 rows.
_LOW_BITS = 20

# A double of less than 2**40 steps is nearer to its step than this; the next decimal is not.
_LARGEST_ERROR = 1e-3


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def nan_to_null(column: str | Column) -> Column:
    """NaN is a value to Spark; here it means "missing", which is NULL."""
    return F.nullif(_col(column), F.lit(float("nan")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL when the denominator is zero."""
    return F.try_divide(numerator, denominator)


def rounded(column: Column, digits: int | None) -> Column:
    """Round half away from zero; ``None`` keeps full precision."""
    return column if digits is None else F.round(column, digits)


def missing_share(column: str | Column, scale: float = 100.0) -> Column:
    """Aggregate: share of NULLs in percent, NULL over no rows."""
    return ratio(F.lit(scale) * F.count_if(_col(column).isNull()), F.count(F.lit(1)))


def _whole_steps(value: Column, resolution: int) -> tuple[Column, Column]:
    """The value in steps of its resolution, rounded, and whether it has further decimals."""
    scaled = value * float(10**resolution)
    whole = F.rint(scaled)
    return whole, F.abs(scaled - whole) > _LARGEST_ERROR


def _too_fine(resolution: int, what: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"more than {resolution} decimals: "), what))


def _steps(value: Column, resolution: int) -> Column:
    """The value in whole steps of its resolution."""
    whole, finer = _whole_steps(value, resolution)
    told = _too_fine(resolution, value.cast("string"))
    return F.when(finer, told.cast("bigint")).otherwise(whole.cast("bigint"))


def step_parts(column: str | Column, resolution: int) -> dict[str, Column]:
    """Whole numbers of a value whose sums, added or subtracted, make up a steady mean.

    :func:`mean_of_parts` puts the sums together. A value that is no whole number of steps
    is only counted, so that it matters where it is part of a mean.
    """
    value = _col(column)
    whole, finer = _whole_steps(value, resolution)
    units = F.when(~finer, whole.try_cast("bigint"))
    return {
        "n": value.isNotNull().cast("bigint"),
        "high": F.coalesce(F.shiftright(units, _LOW_BITS), F.lit(0)).cast("bigint"),
        "low": F.coalesce(units.bitwiseAND((1 << _LOW_BITS) - 1), F.lit(0)).cast("bigint"),
        "finer": (value.isNotNull() & units.isNull()).cast("bigint"),
    }


def _joined(high: Column, low: Column) -> Column:
    """A total from the sums of its values' parts."""
    high, low = high.cast("decimal(28,0)"), low.cast("decimal(28,0)")
    return (high * F.lit(1 << _LOW_BITS).cast("decimal(8,0)") + low).cast("decimal(38,0)")


def mean_of_parts(sums: dict[str, Column], resolution: int) -> Column:
    """The mean that sums of :func:`step_parts` make up, NULL over no value."""
    mean = mean_of(_joined(sums["high"], sums["low"]), sums["n"], resolution)
    told = _too_fine(resolution, F.concat(sums["finer"].cast("string"), F.lit(" values")))
    return F.when(sums["finer"] > 0, told.cast("double")).otherwise(mean)


def steady_total(
    column: str | Column,
    resolution: int | None = None,
    over: WindowSpec | None = None,
) -> Column:
    """Sum of the non-missing values, as an aggregate or over a window.

    A sum of doubles depends on the order of its terms in the last bits, which
    is enough to flip a rounding tie or a threshold when partitions change. When
    the sensor's ``resolution`` (number of decimals) is given, values are added
    as whole multiples of that step: the result counts steps, and is the same
    for every partitioning. Values must be finite, and their steps
    below 2**40. A value with further decimals raises: it would be rounded away.
    """
    value = _col(column)
    bind = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if resolution is None:
        return bind(F.sum(value))
    units = _steps(value, resolution)
    return _joined(
        bind(F.sum(F.shiftright(units, _LOW_BITS))), bind(F.sum(units.bitwiseAND((1 << _LOW_BITS) - 1)))
    )


def mean_of(total: Column, count: Column, resolution: int | None = None) -> Column:
    """Mean from a steady total and a count, with a single rounding."""
    step = 1.0 if resolution is None else float(10**resolution)
    return ratio(total.cast("double"), count * F.lit(step))


def steady_mean(
    column: str | Column,
    resolution: int | None = None,
    over: WindowSpec | None = None,
) -> Column:
    """Mean of the non-missing values; see :func:`steady_total`."""
    value = _col(column)
    if resolution is None:
        mean = F.avg(value)
        return mean if over is None else mean.over(over)
    count = F.count(value) if over is None else F.count(value).over(over)
    return mean_of(steady_total(value, resolution, over), count, resolution)
