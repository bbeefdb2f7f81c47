"""Shards from a permutation-filled lookup table.

Every shard has its own preference order of the table's slots, a permutation that
its name fixes: ``offset + j * skip`` modulo a prime size. Shards take turns, and each
claims the first free slot of its order, until the table is full. All shards get
the same number of slots, up to one, and when a shard comes or goes few slots change
hands. A document's shard is the owner of its key's slot: one look into a table whose
size is a parameter, which is why it can be broadcast.

Defined results: a missing key counts as an empty text, so all such rows share a
shard. Equal keys share a shard, however many rows have them; ``write_shards`` lets
many tasks write one shard. The other columns stay as they are; a column named like
a new one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: The table's size: a prime, and at least a hundred times the number of shards.
SLOTS = 4099

#: No table may be larger: its rows are broadcast.
MOST_SLOTS = 1 << 20

#: Hexadecimal digits of a hash that are used as a number.
_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the owner of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    place = np.arange(slots, dtype=np.int64)
    orders = [
        (_number(f"{name}/offset") + place * (_number(f"{name}/skip") % (slots - 1) + 1)) % slots
        for name in shards
    ]
    owner = np.full(slots, -1, dtype=np.int64)
    reached = [0] * len(shards)
    for turn in range(slots):
        shard = turn % len(shards)
        order, j = orders[shard], reached[shard]
        while owner[order[j]] >= 0:
            j += 1
        owner[order[j]] = shard
        reached[shard] = j + 1
    return owner


def slot_of(key: str, slots: int) -> Column:
    """The slot of a key's text, the same in any SQL engine."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the ``slot`` and ``shard`` of each row."""
    owner = lookup_table(shards, slots)
    table = df.sparkSession.createDataFrame(
        [(slot, shards[shard]) for slot, shard in enumerate(owner.tolist())], "__slot int, __shard string"
    )
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    placed = df.withColumn("__at", slot_of(key, slots).cast("int"))
    return placed.join(F.broadcast(table), F.col("__at") == F.col("__slot")).select(
        *rest, F.col("__at").cast("long").alias("slot"), F.col("__shard").alias("shard")
    )


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, slots: int = SLOTS) -> None:
    """Write one folder per shard; every task writes the rows it holds, without a shuffle."""
    place(df, key, shards, slots).write.partitionBy("shard").parquet(path)
