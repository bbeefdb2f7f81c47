"""Words, shingles and their 64-bit hashes for whole Arrow batches of texts.

Everything works on the UTF-8 bytes of a batch at once. A word is a run of bytes
outside space and ``\\x09`` to ``\\x0D``; A to Z count as a to z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SEEDS = np.random.Generator(np.random.PCG64(20240611))

#: A random number for every byte; A to Z count as a to z in the second table.
EXACT = _SEEDS.integers(0, 1 << 63, 256, dtype=np.uint64)
FOLDED = EXACT[_LOWER]
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes hashed at a time; longer only for a single longer word.
BLOCK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a missing text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _power(length: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < length:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(length, BLOCK), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word's number of each text.

    A word is a run of bytes that the table ``outside`` does not mark.
    """
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED
) -> np.ndarray:
    """One hash for the bytes of each span; starts and ends both ascend."""
    return beginning_hashes(data, starts, ends, [], table)[0]


def beginning_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: list[tuple[np.ndarray, np.ndarray]],
    table: np.ndarray = FOLDED,
) -> list[np.ndarray]:
    """:func:`span_hashes`, and for each of ``inner`` those of the beginnings of some spans.

    ``inner`` has the numbers of these spans, which ascend, and where the beginnings end.
    """
    wanted = [(np.arange(len(starts)), ends), *inner]
    out = [np.empty(len(which), dtype=np.uint64) for which, _ in wanted]
    i = 0
    while i < len(starts):
        origin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, origin + BLOCK, side="right")))
        up, down = _power(int(ends[j - 1] - origin) + 1)
        total = np.zeros(ends[j - 1] - origin + 1, dtype=np.uint64)
        np.cumsum(table[data[origin:ends[j - 1]]] * up[:len(total) - 1], out=total[1:])
        for (which, stops), hashes in zip(wanted, out):
            cut = slice(*np.searchsorted(which, (i, j)))
            s, e = starts[which[cut]] - origin, stops[cut] - origin
            hashes[cut] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return [mix(hashes) for hashes in out]


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of each text, and their offsets.

    A text of fewer words has one, of all its words; a text without words has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], sizes)
    length = np.repeat(np.minimum(counts, width), sizes)
    hashes = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[at + k]
        hashes = np.where(k < length, (hashes ^ part) * _STEP + (hashes >> np.uint64(29)), hashes)
    return mix(hashes), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values in ascending order without repetition, and their offsets."""
    values = values.copy()
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[s:e].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    edges = offsets[:-1]
    new[edges[edges < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def per_text(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty: int = 0) -> np.ndarray:
    """``ufunc`` over the values of each text."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def characters(data: np.ndarray) -> np.ndarray:
    """Where each character starts, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
