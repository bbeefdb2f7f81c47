"""Readers. Schemas are never inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import as_category
from ..schema import MISSING_TOKENS, SEASONS


#: Column that holds the text of a line that does not fit the header.
REJECTED = "__rejected"


def _csv_text(spark: SparkSession, path: str | Sequence[str], malformed: str = "raise") -> DataFrame:
    """All columns of a CSV as text, every file checked against the header.

    A line with a field too few or too many, which is also what a quote that is left
    open leads to, raises, or comes with its whole text in ``REJECTED``. Every line is
    split into all its fields: a reader that only looks for some would not notice.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{path} not found") from error
        raise
    keep = malformed == "keep"
    fields = [T.StructField(name, T.StringType()) for name in [*header, *[REJECTED] * keep]]
    return (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("escape", '"')
        .option("mode", "PERMISSIVE" if keep else "FAILFAST")
        .option("columnNameOfCorruptRecord", REJECTED)
        .csv(path)
    )


def _missing_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    def value(c: str) -> Column:
        text = F.col(f"`{c}`")
        return F.when(~F.trim(text).isin(MISSING_TOKENS), text).alias(c)

    return df.select(*[value(c) if columns is None or c in columns else c for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw readings as text, with every spelling of "missing" turned into NULL.

    A missing path raises ``FileNotFoundError`` with the path in its message. A line
    that does not fit the header fails the job that reads it; see
    :func:`read_raw_lines` for a way to set such lines aside.
    """
    return _missing_to_null(_csv_text(spark, path))


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the raw files: fields as text, ``__rejected`` and ``__file``.

    ``__rejected`` is the text of a line that does not fit the header, NULL for the
    others. See :func:`accepted` and :func:`rejects`.
    """
    lines = _csv_text(spark, path, "keep").withColumn("__file", F.col("_metadata.file_path"))
    fields = [c for c in lines.columns if c not in (REJECTED, "__file")]
    # Spark refuses to read only the text of spoilt lines, so it comes with a bit of a field
    nothing = F.substring(F.coalesce(F.col(f"`{fields[0]}`"), F.lit("")), 1, 0)
    text = F.concat(F.col(REJECTED), nothing).alias(REJECTED)
    return _missing_to_null(lines.select(*[f"`{c}`" for c in fields], text, "__file"), fields)


def accepted(lines: DataFrame) -> DataFrame:
    """The raw readings among the lines."""
    return lines.where(F.col(REJECTED).isNull()).drop(REJECTED, "__file")


def rejects(lines: DataFrame) -> DataFrame:
    """``(file, text)`` of the lines that are no readings."""
    return lines.where(F.col(REJECTED).isNotNull()).select(
        F.col("__file").alias("file"), F.col(REJECTED).alias("text")
    )


def read_clean_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned readings; Parquet keeps all types."""
    return spark.read.parquet(path)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned readings from CSV, with types, timestamp and season restored."""
    from ..operators.cleaning import typed

    df = typed(_missing_to_null(_csv_text(spark, path)))
    if "season" in df.columns:
        df = df.withColumn("season", as_category("season", SEASONS))
    return df
