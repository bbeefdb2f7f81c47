"""Periodic runs of words: stretches that repeat a pattern several times in a row.

A run is a stretch of consecutive words with smallest period ``p`` (words ``p`` apart
are the same), at least ``repeats`` periods and ``least`` words long, which no word on
either side extends. Every run of period ``p`` covers two places ``i`` and ``i + p``
where ``i`` is a multiple of ``(repeats - 1) * p``, so a harmonic grid of about
``n log n`` pairs of places finds them all; how far a pair agrees to either side gives
the run. Most pairs differ within a few words. The others are extended at once by an
index of longest common extensions (:class:`Extensions`), which sorts only the suffixes
of a difference cover.

Words are compared by their bytes, never by hashes. Texts are handled in blocks of
about a megabyte; a longer single text is a block of its own and takes some 400 bytes
of memory a word while its runs are searched.

Defined results: a missing, empty or blank text has no words and no run. Repeated ids
and rows are searched each on their own. Other columns are ignored. No document: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing as H

#: Every difference modulo 31 is the difference of two of these places.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])

#: Words that a pair of places is compared by before an index is built for its text.
FEW = 8

#: Pairs of places that are looked at together.
PAIRS = 1 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _steps_to_samples() -> np.ndarray:
    """``[i, d]``: steps until a place of residue ``i`` and the one ``d`` on are both samples."""
    sample = np.isin(np.arange(MODULUS), COVER)
    i, d, k = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    both = sample[(i + k) % MODULUS] & sample[(i + d + k) % MODULUS]
    return both.argmax(axis=2)


_STEPS = _steps_to_samples()
_SAMPLE_NUMBER = np.searchsorted(COVER, np.arange(MODULUS))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """1 for the smallest key, 2 for the next one, and so on."""
    return np.unique(keys, return_inverse=True)[1] + 1


class Extensions:
    """How many numbers of a sequence agree from two places on.

    Only suffixes that start at samples, places whose residue is in the cover, are
    sorted: first by ``MODULUS`` numbers, then by doubling, as the sample ``MODULUS``
    times a power of two further on is again one. Two places are compared number by
    number until both are samples, at most ``MODULUS`` times; from there the answer is
    the least of the neighbouring common prefixes between their ranks, which a sparse
    table tells.
    """

    def __init__(self, sequence: np.ndarray):
        self._length = len(sequence)
        self._line = np.concatenate([np.asarray(sequence, np.int64) + 1, np.zeros(MODULUS + 1, np.int64)])
        periods = -(-self._length // MODULUS)
        at = (np.arange(periods)[:, None] * MODULUS + COVER).ravel()
        at = at[:np.searchsorted(at, self._length)]
        names = [self._first_names(at)]
        while len(at) and names[-1].max() < len(at):
            names.append(self._doubled(names[-1], len(COVER) << (len(names) - 1)))
        self._rank = names[-1] - 1
        self._least = self._sparse(self._neighbours(at, names[:-1]))

    def _first_names(self, at: np.ndarray) -> np.ndarray:
        names = np.ones(len(at), np.int64)
        if not len(at):
            return names
        base = int(self._line.max()) + 1
        done = 0
        while done < MODULUS:
            keys, most = names, len(at) + 1
            while done < MODULUS and most * base < 1 << 62:
                keys, most, done = keys * base + self._line[at + done], most * base, done + 1
            names = _ranks(keys)
        return names

    @staticmethod
    def _doubled(names: np.ndarray, shift: int) -> np.ndarray:
        behind = np.zeros_like(names)
        behind[:max(len(names) - shift, 0)] = names[shift:]
        return _ranks(names * (len(names) + 1) + behind)

    def _neighbours(self, at: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Numbers that each sample in sorted order has in common with the next one."""
        order = np.argsort(self._rank)
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), np.int64)
        for level in range(len(names) - 1, -1, -1):
            there = np.flatnonzero(np.maximum(x, y) < len(at))
            same = there[names[level][x[there]] == names[level][y[there]]]
            for side in (x, y):
                side[same] += len(COVER) << level
            common[same] += MODULUS << level
        a, b = at[order[:-1]] + common, at[order[1:]] + common
        more, _ = self._compared(a, b, np.full(len(a), MODULUS))
        return common + more

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that agree one by one, ``most`` at most, and whether all these do."""
        agreed = np.zeros(len(a), np.int64)
        going = np.flatnonzero(most > 0)
        for k in range(MODULUS):
            going = going[self._line[a[going] + k] == self._line[b[going] + k]]
            agreed[going] = k + 1
            going = going[most[going] > k + 1]
            if not len(going):
                break
        return agreed, agreed == most

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        levels = [values]
        while 2 << (len(levels) - 1) <= len(values):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        return levels

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for two samples each."""
        x, y = (self._rank[p // MODULUS * len(COVER) + _SAMPLE_NUMBER[p % MODULUS]] for p in (a, b))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(self._least[k][low[of]], self._least[k][high[of] - (1 << k)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers that agree from ``i`` and ``j > i`` on."""
        steps = _STEPS[i % MODULUS, (j - i) % MODULUS]
        agreed, all_agree = self._compared(i, j, steps)
        deep = np.flatnonzero(all_agree & (j + steps < self._length))
        agreed[deep] += self._common(i[deep] + steps[deep], j[deep] + steps[deep])
        return agreed


def _grid(counts: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, place, period)`` of all pairs of places, in pieces; ``counts`` words each."""
    longest = counts // repeats
    ends = np.cumsum(longest)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        number = np.arange(first, min(first + PAIRS, ends[-1]))
        text = np.searchsorted(ends, number, side="right")
        period = number - (ends[text] - longest[text]) + 1
        step = (repeats - 1) * period
        upto = np.cumsum(-(-(counts[text] - period) // step))
        before = np.concatenate([[0], upto[:-1]])
        for low in range(0, int(upto[-1]), PAIRS):
            high = min(low + PAIRS, int(upto[-1]))
            a, b = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high - 1, side="right") + 1
            pair = np.repeat(np.arange(a, b), np.minimum(upto[a:b], high) - np.maximum(before[a:b], low))
            yield text[pair], (np.arange(low, high) - before[pair]) * step[pair], period[pair]


def _agreeing(line: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Numbers around ``i`` and ``j`` that agree, at most ``most`` to either side."""
    total = np.zeros(len(i), np.int64)
    for direction in (1, -1):
        going = np.arange(len(i))
        for k in range(FEW):
            offset = k if direction > 0 else -k - 1
            going = going[most[going] > k]
            going = going[line[i[going] + offset] == line[j[going] + offset]]
            total[going] += 1
    return total


def runs_of(words: np.ndarray, offsets: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, ...]:
    """``(text, start, length, period)`` of all runs, by text, start and period.

    ``words`` are the numbers of the words of all texts, ``offsets`` where each begins.
    """
    counts = np.diff(offsets)
    # a number of its own stands before, between and behind the texts
    edges = words.max(initial=-1) + 1 + np.arange(len(offsets))
    line = np.insert(words.astype(np.int64), offsets, edges)
    first = offsets[:-1] + np.arange(1, len(offsets))
    found = []
    for text, place, period in _grid(np.where(counts >= least, counts, 0), repeats):
        i = first[text] + place
        same = line[i] == line[i + period]
        text, i, period = text[same], i[same], period[same]
        most = np.minimum(np.maximum(least, repeats * period) - period, FEW)
        near = _agreeing(line, i, i + period, most) >= most
        found.append((text[near], i[near], period[near]))
    text, i, period = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    if not len(i):
        return text, i, i, period

    wanted = np.zeros(len(counts), bool)
    wanted[text] = True
    kept = np.insert(np.repeat(wanted, counts), offsets, True)
    line, moved = line[kept], np.cumsum(kept) - 1
    i, first = moved[i], moved[first]
    forward, backward = Extensions(line), Extensions(line[::-1])
    last = len(line) - 1
    ahead = forward.common(i, i + period)
    behind = backward.common(last - (i + period - 1), last - (i - 1))
    length = behind + period + ahead
    run = length >= np.maximum(least, repeats * period)
    text, start, length, period = text[run], (i - behind - first[text])[run], length[run], period[run]
    # a stretch is found for every multiple of its smallest period as well
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (a[order] for a in (text, start, length, period))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, period = (a[new] for a in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(a[order] for a in (text, start, length, period))


def _joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ``counts`` words each, the words joined by one space."""
    first = np.zeros(len(starts) + 1, bool)
    first[np.concatenate([[0], np.cumsum(counts)])] = True
    first = first[:-1]
    ends = np.cumsum(sizes + ~first)
    out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - (ends - sizes), sizes)
    at = np.arange(len(shift)) + np.repeat(ends - np.cumsum(sizes), sizes)
    out[at] = data[at + shift]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.LargeStringArray.from_buffers(
        len(counts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)
    ).cast(pa.string())


def _found(batch: pa.RecordBatch, repeats: int, least: int) -> pa.RecordBatch:
    data, offsets = H.buffers(batch.column("text"))
    starts, ends, firsts = H.word_spans(data, offsets)
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    spelled = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~H.SPACE[data]])]
    )
    words = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text, start, length, period = runs_of(words, firsts, repeats, least)
    begins = firsts[text] + start
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begins + period, 1)
    np.add.at(change, begins + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    counts = np.diff(np.concatenate([[0], np.cumsum(kept)])[firsts])
    runs = pa.StructArray.from_arrays([pa.array(a) for a in (start, length, period)], fields=list(_RUN))
    lists = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        batch.column("id"), pa.array(np.diff(firsts)), pa.ListArray.from_arrays(pa.array(lists), runs),
        _joined(data, starts[kept], sizes[kept], counts),
    ], names=["id", "n_words", "runs", "collapsed"])


def find_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    repeats: int = 4, least: int = 6,
) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row of ``docs``.

    ``runs`` are in the order of their starts, then periods. ``collapsed`` is the text
    without the words that a run contains after its first period, joined by one space.
    """
    if repeats < 2:
        raise ValueError("a run repeats its pattern at least twice")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for batch in H.slices(whole, "text"):
                yield _found(batch, repeats, least)

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"id {id_type}, n_words long, runs {RUNS}, collapsed string")
