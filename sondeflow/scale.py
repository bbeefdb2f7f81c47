"""Joining a big table with a table of its own groups, safely at any size.

The operators never hint a broadcast on trust. A per-group table is either
bounded by construction (one row, one row per listed column, one row per
calendar month), or it is computed once and measured first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from .session import ensure_checkpoint_dir

#: Group tables up to this size are sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

#: A group is hot when it holds more than this fraction of all rows. No more
#: than ``1 / HOT_SHARE`` groups can, so the hot ones always fit a broadcast.
HOT_SHARE = 1e-4


def materialized(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and read it from there.

    A reliable checkpoint survives lost executors, and later jobs neither
    recompute ``df`` nor can see another version of it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Measure a computed table: fixed width per column plus its text."""
    text = [
        F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0))
        for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    width = 16 + 8 * len(df.columns)
    size = reduce(lambda a, b: a + b, text, F.count(F.lit(1)) * width)
    return df.agg(size).first()[0] <= (BROADCAST_BYTES if limit is None else limit)


def attach(
    big: DataFrame,
    groups: DataFrame,
    keys: list[str],
    how: str = "inner",
    null_keys: bool = False,
    broadcast: bool = False,
) -> DataFrame:
    """Join on equally named keys and keep those of ``big``.

    With ``null_keys`` NULL pairs with NULL, as grouping does. Keys that cannot
    be NULL are compared plainly, which joins faster.
    """
    theirs = {k: f"__{k}" for k in keys}
    nullable = {f.name for f in big.schema.fields if f.nullable} if null_keys else set()
    matches = reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(t)) if k in nullable else F.col(k) == F.col(t)
        for k, t in theirs.items()
    ])
    groups = groups.withColumnsRenamed(theirs)
    joined = big.join(F.broadcast(groups) if broadcast else groups, matches, how)
    return joined.drop(*theirs.values())


def spread_join(
    big: DataFrame,
    groups: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "inner",
    null_keys: bool = False,
) -> DataFrame:
    """Join with a computed group table that is too large for a broadcast.

    ``weight`` counts the rows of ``big`` under a key. Keys that hold a large
    share of the rows are broadcast, and only the rest is shuffled: no task
    receives a hot key.
    """
    total = groups.select(*keys, weight).distinct().agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > total * HOT_SHARE
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    rest = attach(big, hot.select(*keys).distinct(), keys, "left_anti", null_keys, broadcast=True)
    return attach(big, hot, keys, how, null_keys, broadcast=True).unionByName(
        attach(rest, cold, keys, how, null_keys)
    )
