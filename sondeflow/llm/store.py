"""Tables in the shared folder, and filters of fixed size that replace big joins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ensure_checkpoint_dir

#: Slots of a filter. It is kept as at most ``slots / 64`` rows of two 64-bit
#: numbers: 16 MiB for 2**26 slots.
FILTER_SLOTS = 1 << 26


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there.

    Cuts the lineage: a lost executor costs no recomputation of what is written,
    and every later read sees the same rows.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def comparable(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The columns in a form that can be ordered and hashed: maps, which can not, as text."""
    names = df.columns if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    quoted = {n: F.col(f"`{n}`") for n in names}
    return [F.to_json(F.struct(c)) if _has_map(kinds[n]) else c for n, c in quoted.items()]


def _slot(keys: tuple, slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def slot_filter(df: DataFrame, *keys: str, slots: int = FILTER_SLOTS) -> DataFrame:
    """The hash slots that the keys occupy, 64 to a row.

    The size is bounded by ``slots`` whatever the number of keys, so the result can
    be broadcast without measuring it.
    """
    slot = _slot(keys, slots)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__slot") % 64).cast("int"))
    return (
        df.select(slot.alias("__slot"))
        .groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    )


def flagged(
    df: DataFrame, flag: str, bitmaps: DataFrame, *keys: str, slots: int = FILTER_SLOTS
) -> DataFrame:
    """``df`` with a boolean: may the keys be among those of the filter?

    Never false for a key of the filter. Keys that share a slot with another one are
    flagged as well, so an exact step has to follow; with far more keys than slots
    everything is flagged, which costs time and no row.
    """
    hit = F.getbit("__bits", (F.col("__slot") % 64).cast("int")) == 1
    return (
        df.withColumn("__slot", _slot(keys, slots))
        .join(F.broadcast(bitmaps), F.shiftright("__slot", 6) == F.col("__word"), "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("__slot", "__word", "__bits")
    )


def maybe_in(df: DataFrame, bitmaps: DataFrame, *keys: str, slots: int = FILTER_SLOTS) -> DataFrame:
    """Rows whose keys may be among those of the filter; see :func:`flagged`."""
    return flagged(df, "__maybe", bitmaps, *keys, slots=slots).where("__maybe").drop("__maybe")


def without_ids(docs: DataFrame, id_column: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped (id)``.

    A filter of fixed size lets most rows pass where they are; only those that it
    flags are shuffled with their texts to the exact comparison.
    """
    marked = flagged(docs, "__maybe", saved(slot_filter(dropped, "id"), "dropped"), id_column)
    named = dropped.select(F.col("id").alias("__dropped"))
    exact = marked.where("__maybe").join(named, F.col(id_column) == F.col("__dropped"), "left_anti")
    return marked.where("NOT __maybe").unionByName(exact).drop("__maybe")
