"""Training order: every token sequence gets a global slot by a keyed permutation.

Documents become sequences of a fixed length, the last of each padded. Sequences are
numbered from 0 without a sort: within the task that wrote them, after the counts of
the tasks before. A Feistel network over the smallest even number of bits that
holds all numbers permutes them under a key; a result beyond the last number is
permuted again until it is not (cycle walking), so the slots are exactly 0 to n - 1.
Whoever has the key can go both ways, and no shuffled list exists anywhere.

Slots are cut into shards of equal size, shards are range-partitioned and each task
sorts what it got: the only shuffle of the tokens. A record has a fixed stride, so
sequence ``s`` of a shard starts at byte ``s * stride``, and a reader that stopped
resumes with a single seek.

Defined results: a missing or empty text is one sequence of the closing id. Repeated
rows and ids are sequences of their own. Numbers follow the rows in the order in
which the input is read, and slots the numbers and the key. Other columns are
ignored. No document: no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .store import saved
from .tokens import BLOCK, encoder

#: Tokens of a sequence, and sequences of a shard.
LENGTH, PER_SHARD = 512, 1 << 16

ROUNDS = 6

#: Bytes of a token id on disk, little endian; enough for vocabularies below 65,536.
ID_BYTES = 2


def _round_keys(key: int) -> np.ndarray:
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return H.mix(steps ^ np.uint64(key & ((1 << 64) - 1)))


def _feistel(values: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = values >> np.uint64(half), values & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (H.mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (H.mix(right ^ key) & mask)
    return (left << np.uint64(half)) | right


def permuted(numbers: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """The keyed permutation of ``[0, size)``, or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2) if size > 1 else 1
    keys = _round_keys(key)
    out = _feistel(numbers.astype(np.uint64), half, keys, back)
    while (beyond := out >= np.uint64(size)).any():
        out[beyond] = _feistel(out[beyond], half, keys, back)
    return out.astype(np.int64)


def sequence_batches(path: str, length: int, closing_id: int):
    """mapInArrow function: the sequences of each document, numbered within the task."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, nth = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in H.slices(whole, "text", BLOCK):
                ids, offsets = tokenizer.encode(batch.column("text"))
                if max(closing_id, int(ids.max(initial=0))) >> (8 * ID_BYTES):
                    raise ValueError(f"an id does not fit {8 * ID_BYTES} bits")
                doc, piece, tokens = [], [], []
                for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.append(ids[s:e], np.uint32(closing_id)).astype("<u2").tobytes()
                    for number, at in enumerate(range(0, len(own), ID_BYTES * length)):
                        doc.append(i)
                        piece.append(number)
                        tokens.append(own[at:at + ID_BYTES * length])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(tokens, pa.binary()), pa.array(np.full(len(doc), task), pa.int32()),
                    pa.array(np.arange(nth, nth + len(doc)), pa.int64()),
                ], names=["doc_id", "piece", "tokens", "task", "nth"])
                nth += len(doc)

    return sequences


def slot_batches(first, size: int, key: int, length: int, per_shard: int):
    """mapInArrow function: slot, shard and byte offset, and the tokens at full stride."""
    stride = ID_BYTES * length

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = first.value[batch.column("task").to_numpy()]
            slot = permuted(base + batch.column("nth").to_numpy(), size, key)
            tokens = batch.column("tokens").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride),
                batch.column("doc_id"), batch.column("piece"),
                pa.array([len(t) // ID_BYTES for t in tokens], pa.int32()),
                pa.array([zlib.crc32(t) for t in tokens], pa.int64()),
                pa.array([t.ljust(stride, b"\0") for t in tokens], pa.binary()),
            ], names=["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids_crc32", "tokens"])

    return slots


def training_order(
    docs: DataFrame, tokenizer_path: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD,
    id_column: str = "doc_id", text_column: str = "text", closing_id: int = 0,
) -> DataFrame:
    """All sequences in training order, range-partitioned by shard.

    ``(slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32, tokens)``; tokens
    are 16-bit little-endian ids padded with zeros to the stride, the checksum is
    that of the ids without padding.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    cut = saved(docs.mapInArrow(
        sequence_batches(tokenizer_path, length, closing_id),
        "doc_id long, piece int, tokens binary, task int, nth long",
    ), "sequences")
    # one number per task that read the documents
    counts = {r["task"]: r["count"] for r in cut.groupBy("task").count().collect()}
    sizes = np.array([counts.get(t, 0) for t in range(max(counts, default=-1) + 1)], dtype=np.int64)
    first = docs.sparkSession.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    size = int(sizes.sum())
    placed = cut.mapInArrow(
        slot_batches(first, size, key, length, per_shard),
        "slot long, shard long, byte_offset long, doc_id long, piece int, n_tokens int,"
        " ids_crc32 long, tokens binary",
    )
    # the shard leads the order, so that a writer by shard need not sort again
    return placed.repartitionByRange("shard").sortWithinPartitions("shard", "slot")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write each shard as one file of fixed-stride records below ``path/shard=<n>``.

    A record is the tokens at full stride and a line feed. Spark's text writer passes
    the bytes through unchanged, to any file system that it can write to.
    """
    records = ordered.select("shard", F.col("tokens").cast("string").alias("value"))
    records.write.partitionBy("shard").text(path)


def read_shard(spark, path: str, shard: int, length: int = LENGTH):
    """The records of a shard in slot order, as an RDD of bytes at full stride."""
    stride = ID_BYTES * length
    records = spark.sparkContext.binaryRecords(f"{path}/shard={shard}", stride + 1)
    return records.map(lambda record: bytes(record[:stride]))
