"""Best-fit-decreasing packing of tokenized documents into fixed-size sequences.

Pieces are placed from the longest to the shortest, each into the open sequence
with the least room that still holds it, which a segment tree over the remaining
capacities finds in logarithmic time. Pieces of one length are interchangeable, so
the placing needs only their counts: a table of at most ``capacity`` rows, whatever
the corpus. It yields runs ("so many pieces of this length, so many per sequence,
from this sequence and offset on"), and each piece finds its own place from its
rank among the pieces of its length.

A sequence holds fewer than 64 different lengths when the capacity is 2048 and a
length splits one range of equal sequences at most, so there are fewer than 400,000
runs for any corpus; some thousands are usual. They are the only thing broadcast.

Defined results: a missing or empty text is one piece of the closing id alone.
Repeated ids and repeated rows are packed each on their own. Other columns are
ignored. No document: no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import hashing as H
from .store import saved
from .tokens import BLOCK, encoder

#: Rows that one task numbers, so that a hot length is numbered by many tasks.
ROWS_PER_SALT = 1 << 14

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """``count`` pieces of ``length``: ``each`` per sequence, from ``sequence`` on at ``offset``."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


class CapacityTree:
    """Segment tree over remaining capacities; a leaf knows whether a sequence has it."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._any = [False] * (2 * self._leaves)

    def mark(self, room: int, present: bool) -> None:
        node = room + self._leaves
        self._any[node] = present
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest present room of at least ``least``."""
        node = least + self._leaves
        if not self._any[node]:
            while node > 1 and (node % 2 or not self._any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if self._any[2 * node] else 2 * node + 1
        return node - self._leaves


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[Run]:
    """Place ``counts[length]`` pieces of each length, longest first."""
    tree = CapacityTree(capacity)
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            open_ranges.setdefault(room, []).append((first, many))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                needed = -(-left // (capacity // length))
                put(room, opened, needed)
                opened += needed
            first, many = open_ranges[room].pop()
            if not open_ranges[room]:
                tree.mark(room, False)
            # a sequence that has just taken a piece is the tightest while it has room
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append(Run(length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if left and full < many:
                runs.append(Run(length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full += 1
                left = 0
            put(room, first + full, many - full)
    return runs


def piece_batches(path: str, capacity: int, with_ids: bool, closing_id: int = 0):
    """mapInArrow function: the pieces of each document."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for whole in batches:
            for batch in H.slices(whole, "text", BLOCK):
                ids, offsets = tokenizer.encode(batch.column("text"))
                doc, piece, start, length, crc, held = [], [], [], [], [], []
                for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.append(ids[s:e], np.uint32(closing_id)).astype("<u4")
                    at = 0
                    end = len(own) % capacity or capacity
                    number = 0
                    while at < len(own):
                        part = own[at:end].tobytes()
                        doc.append(i)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                        at, end, number = end, end + capacity, number + 1
                columns = [
                    batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces


def cut_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_column: str = "doc_id",
    text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document, each closed by id 0.

    Only a document of more than ``capacity`` ids is cut; its first piece is the
    short one. ``with_ids`` adds the ids as little-endian 32-bit numbers.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.mapInArrow(piece_batches(tokenizer_path, capacity, with_ids), schema)


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Number the pieces of each length from 0.

    A length that many pieces share is spread over salts: each salt is numbered on
    its own and starts where the counts of the salts before it end.
    """
    salts = -(-rows // ROWS_PER_SALT) if rows else 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    return (
        ranked.join(base, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    )


def place_batches(runs):
    """mapInArrow function: sequence and offset of each ranked piece; ``runs`` is broadcast."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        # length and rank in one ascending key: ranks stay below 2**50
        keys = (table[:, 0] << 50) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, (length << 50) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 4] + nth // run[:, 3]
            offset = run[:, 5] + nth % run[:, 3] * length
            batch = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    return places


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; read several times, so save them first."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(best_fit_runs(counts, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, len(Run._fields))
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    ranked = _ranked(pieces, sum(counts.values()))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, F.col("rank").cast("long")).mapInArrow(
        place_batches(shared), f"{columns}, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **columns) -> DataFrame:
    """Where each piece of each document goes, with its place and checksum."""
    return pack(saved(cut_documents(docs, tokenizer_path, capacity, **columns), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: ``(sequence_id, ids)``; pieces need their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
