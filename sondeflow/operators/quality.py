"""Physical limits, the acceptance gate and the quality summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import one_row_per_column
from ..schema import PHYSICAL_RULES, SEASONS, RangeRule
from .duplicates import excess_rows


def out_of_range(df: DataFrame, rule: RangeRule) -> Column | None:
    """Whether a row breaks a rule; None when the frame lacks its columns.

    A missing value never breaks a rule.
    """
    limits = []
    for name in rule.columns:
        if name in df.columns:
            if rule.low is not None:
                limits.append(F.col(name) < rule.low)
            if rule.high is not None:
                limits.append(F.col(name) > rule.high)
    if not limits:
        return None
    return F.coalesce(reduce(lambda a, b: a | b, limits), F.lit(False))


def range_report(df: DataFrame, rules: Sequence[RangeRule] = PHYSICAL_RULES) -> DataFrame:
    """Rows that break each rule, as ``(check, failing_rows)`` from one scan.

    Rules whose columns are absent are left out.
    """
    checks = {r.check: out_of_range(df, r) for r in rules}
    checks = {name: test for name, test in checks.items() if test is not None}
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, failing_rows bigint")
    wide = df.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    return one_row_per_column(
        wide, "check", {name: {"failing_rows": F.col(name)} for name in checks}
    )


def range_counts(df: DataFrame, rules: Sequence[RangeRule] = PHYSICAL_RULES) -> dict[str, int]:
    """The range report as a dictionary on the driver (one entry per rule)."""
    return {r["check"]: r["failing_rows"] for r in range_report(df, rules).collect()}


def breaks_any(df: DataFrame, rules: Sequence[RangeRule]) -> Column:
    """Whether a row breaks at least one rule."""
    tests = [t for t in (out_of_range(df, r) for r in rules) if t is not None]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def implausible_rows(
    df: DataFrame, rules: Sequence[RangeRule] = PHYSICAL_RULES, name: str = "failing_rows"
) -> DataFrame:
    """Number of rows that break at least one rule."""
    return df.agg(F.count_if(breaks_any(df, rules)).alias(name))


def negative_rows(df: DataFrame, columns: Sequence[str], name: str = "negative_value_rows") -> DataFrame:
    """Number of rows with a negative value in any of the columns."""
    return implausible_rows(df, [RangeRule(name, tuple(columns), low=0)], name)


def measure_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column."""
    wide = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    )
    return one_row_per_column(wide, "parameter", {
        c: {"min": F.col(f"{c}_min"), "max": F.col(f"{c}_max")} for c in columns
    })


def gate_report(
    df: DataFrame,
    original_row_count: int,
    key: str = "record_number",
    timestamp_column: str = "timestamp",
    season_column: str = "season",
    rejected_rows: int | None = None,
    most_rejected: int | None = None,
) -> DataFrame:
    """Acceptance checks of a cleaned table as ``(check, passed, detail)``.

    Row count unchanged, key unique, timestamp typed, a season on every row, and
    all four seasons present. Only the key is shuffled, counted per task first;
    the other checks are plain totals over other columns. Where rows were set aside,
    ``rejected_rows`` of the original ones, they are counted with the table's and
    reported by a check of their own, which fails beyond ``most_rejected``.
    """
    is_time = isinstance(df.schema[timestamp_column].dataType, (T.TimestampType, T.TimestampNTZType))
    season = F.col(season_column)
    found = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.bool_or(season == s), F.lit(False)).cast("bigint") for s in SEASONS],
    )
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(season.isNull()).alias("no_season"),
        F.count_if(~season.isin(SEASONS)).alias("unknown"),
        found.alias("seasons"),
    )
    repeats = excess_rows(df, [key], name="repeats")
    totals = one_row_per_column(facts, "check", {
        "row_count_unchanged": {
            "passed": F.col("rows") == original_row_count - (rejected_rows or 0), "detail": F.col("rows"),
        },
        **({} if rejected_rows is None else {"rows_rejected": {
            "passed": F.lit(most_rejected is None or rejected_rows <= most_rejected),
            "detail": F.lit(rejected_rows).cast("bigint"),
        }}),
        "timestamp_typed": {
            "passed": F.lit(is_time), "detail": F.lit(0 if is_time else 1).cast("bigint"),
        },
        "season_present": {"passed": F.col("no_season") == 0, "detail": F.col("no_season")},
        "seasons_complete": {
            "passed": (F.col("seasons") == len(SEASONS)) & (F.col("unknown") == 0),
            "detail": F.col("seasons"),
        },
    })
    return totals.unionByName(one_row_per_column(repeats, "check", {
        "key_unique": {"passed": F.col("repeats") == 0, "detail": F.col("repeats")},
    }))


def assert_clean(
    df: DataFrame, original_row_count: int, skip: Sequence[str] = (), **options: str | int | None
) -> None:
    """Raise ``AssertionError`` naming the checks that failed, but for those to ``skip``."""
    report = gate_report(df, original_row_count, **options).collect()
    failed = [r["check"] for r in report if not r["passed"] and r["check"] not in skip]
    if failed:
        raise AssertionError("failed checks: " + ", ".join(failed))


def quality_summary(
    raw: DataFrame,
    cleaned: DataFrame,
    key: str = "record_number",
    rules: Sequence[RangeRule] = PHYSICAL_RULES,
    raw_key: str | None = None,
) -> DataFrame:
    """Six headline numbers of a cleaning run, all computed from the data."""
    copies = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("original"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("copies"),
    )
    final = cleaned.agg(
        F.count_if(breaks_any(cleaned, rules)).alias("implausible"),
        F.count(F.lit(1)).alias("final"),
    )
    repeats = excess_rows(raw, [raw_key or key], name="repeats")
    parts = copies.unionByName(repeats, True).unionByName(final, True)
    numbers = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return one_row_per_column(numbers, "metric", {
        "Original records": {"value": F.col("original")},
        "Fully duplicated rows found": {"value": F.col("copies")},
        "Duplicate record numbers found": {"value": F.col("repeats")},
        "Rows failing plausibility checks": {"value": F.col("implausible")},
        "Records removed during cleaning": {"value": F.col("original") - F.col("final")},
        "Final records": {"value": F.col("final")},
    })
