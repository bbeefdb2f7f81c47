"""Parity-sketch join: all pairs of texts whose word n-gram sets are similar.

Every distinct shingle XORs its 64-bit word into one of the blocks of a sketch, so
two sketches differ in at most as many blocks as the sets have different
shingles. A Jaccard similarity of ``t`` bounds that difference by
``(1 - t) / (1 + t)`` of the summed sizes, and by the pigeonhole principle a linked
pair agrees on the remaining blocks. Of the blocks both texts have, each sends
only its most telling ones to the join, in an order that depends on content alone:
when a pair agrees on ``m`` blocks and each side leaves out fewer than ``m``, the
first block of that order among the ``m`` is sent by both. No link is lost.

The number of blocks is fixed per size band (sizes between two powers of two); a
text just above a band's end also takes part in the band below. Sets of up to seven
shingles can differ by one shingle only, so there the whole XOR word is joined with
the words of one shingle less. A second, dense bit sketch refuses most candidates
by its Hamming distance, and what is left is verified on the exact sets.

Links are found in two rounds, so that a group of thousands of near copies never
becomes all of its pairs. First each text is compared with the hubs of its buckets:
that gives trees of linked texts, and looser families of texts
that resemble a common hub. Then only texts of different trees are compared. Within
a family that is done on blocks of bit sketches, of which only pairs that may be linked
come out; across families, on the buckets where they meet. Shared counts of sent
blocks have a lower bound too, which lets each text leave its most crowded buckets
out of the second round.

Defined results: no text, no words: 0 shingles, linked with nothing. Fewer words
than ``width``: the whole sequence is the only shingle. Equal sets form one class,
joined as one text. Rows that share an id are one node; a NULL id is linked with
nothing and has no component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import hashing as H
from .components import connected
from .store import maybe_in, saved, slot_filter, without_ids

#: The smallest band of the block sketches: sizes 8 to 15.
_LOWEST_BAND = 3

_CLASS_A, _CLASS_B, _BLOCK, _ORDER, _BIT, _TINY = (
    np.uint64(x) for x in H._SEEDS.integers(1, 1 << 63, 6, dtype=np.uint64)
)

#: Texts of a family that are compared with as many others at a time.
FAMILY_BLOCK = 2048

#: Bits of the dense sketch are limited to this; larger sets only filter less.
_MOST_BITS = 1 << 16


class Bounds:
    """What a similarity of at least 4/5 implies, in whole numbers.

    ``d <= (a + b) / 9`` for the symmetric difference, ``4 b <= 5 a`` for a <= b.
    A text sends 1 + ``spare`` more blocks than the difference can spoil, so linked
    texts share more than the ``spare`` of the smaller one.
    """

    @staticmethod
    def spare(n):
        return 6 * n // 100

    @staticmethod
    def sent(n):
        """Blocks sent in the own band, where the partner may be larger: d <= n / 4."""
        return n // 4 + 1 + Bounds.spare(n)

    @staticmethod
    def sent_below(n):
        """Blocks sent in the band below, where the partner is smaller: d <= 2 n / 9."""
        return 2 * n // 9 + 1 + Bounds.spare(n)

    @staticmethod
    def blocks(band):
        """Blocks of a band's sketch, 4/3 to 8/3 shingles in each."""
        return 3 * (1 << band) // 4


def _bands(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1, -1)


def _block_keys(
    values: np.ndarray, offsets: np.ndarray, texts: np.ndarray, band: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that the chosen texts send: (number of the text, key)."""
    sizes = np.diff(offsets)[texts]
    at = np.arange(sizes.sum()) + np.repeat(offsets[:-1][texts] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    mine = values[at]
    total = Bounds.blocks(band).astype(np.uint64)
    # the values of a text ascend, so those of a block are neighbours
    block = ((mine >> np.uint64(32)) * total[owner]) >> np.uint64(32)
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    words = np.bitwise_xor.reduceat(H.mix(mine ^ _BLOCK), first)
    held = np.diff(np.concatenate([first, [len(mine)]]))
    owner, block = owner[first], block[first]
    place = H.mix((band[owner].astype(np.uint64) << np.uint64(40)) + block + np.uint64(1))
    keys = H.mix(words ^ place)
    rank = (np.minimum(held, 127).astype(np.uint64) << np.uint64(56)) | (H.mix(keys ^ _ORDER) >> np.uint64(8))

    filled = np.bincount(owner, minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(filled)])
    least = np.zeros(len(texts), dtype=np.uint64)
    for k in np.flatnonzero(filled > wanted).tolist():
        least[k] = np.partition(rank[bounds[k]:bounds[k + 1]], filled[k] - wanted[k])[filled[k] - wanted[k]]
    sent = rank >= least[owner]
    owners, found = [owner[sent]], [keys[sent]]
    # empty blocks come last in the order, and only few small texts need them
    for k in np.flatnonzero(filled < np.minimum(wanted, total.astype(np.int64))).tolist():
        empty = np.setdiff1d(np.arange(total[k], dtype=np.uint64), block[bounds[k]:bounds[k + 1]])
        place = H.mix((np.uint64(band[k]) << np.uint64(40)) + empty + np.uint64(1))
        keys = H.mix(place)
        best = np.argsort(H.mix(keys ^ _ORDER))[::-1][:wanted[k] - filled[k]]
        owners.append(np.full(len(best), k))
        found.append(keys[best])
    return texts[np.concatenate(owners)], np.concatenate(found)


def _signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of a batch: (number of the text, key)."""
    sizes = np.diff(offsets)
    bands = _bands(sizes)
    texts, keys = [], []
    home = np.flatnonzero(bands >= _LOWEST_BAND)
    if len(home):
        t, k = _block_keys(values, offsets, home, bands[home], Bounds.sent(sizes[home]))
        texts.append(t)
        keys.append(k)
    low_end = np.flatnonzero((bands > _LOWEST_BAND) & (4 * sizes <= 5 * ((1 << np.maximum(bands, 0)) - 1)))
    if len(low_end):
        t, k = _block_keys(values, offsets, low_end, bands[low_end] - 1, Bounds.sent_below(sizes[low_end]))
        texts.append(t)
        keys.append(k)
    for k in np.flatnonzero((sizes >= 4) & (sizes <= 8)).tolist():
        # sets this small differ by one shingle at most: the smaller one's word is
        # the larger one's without a shingle
        size = int(sizes[k])
        words = H.mix(values[offsets[k]:offsets[k + 1]] ^ _TINY)
        whole = np.bitwise_xor.reduce(words, keepdims=True)
        out = [H.mix(whole + np.uint64(size))] if size <= 7 else []
        out += [H.mix((whole ^ words) + np.uint64(size - 1))] if size >= 5 else []
        keys.append(np.concatenate(out))
        texts.append(np.full(len(keys[-1]), k))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(text, kind="stable")
    return text[order], key[order]


def _bit_sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each set's parities in 2 to 4 bits per shingle, a power of two of them."""
    bits = np.minimum(64 << np.maximum(_bands(np.diff(offsets)) - 4, 0), _MOST_BITS)
    base = np.concatenate([[0], np.cumsum(bits)])
    sizes = np.diff(offsets)
    at = (H.mix(values ^ _BIT) & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at + np.repeat(base[:-1], sizes), minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd).tobytes()
    cuts = (base // 8).tolist()
    return [packed[s:e] for s, e in zip(cuts[:-1], cuts[1:])]


def hamming(a: bytes, b: bytes) -> int:
    """Differing parities; the longer sketch is folded to the length of the other."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in sorted((a, b), key=len))
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = H.buffers(batch.column("text"))
    starts, ends, words = H.word_spans(data, offsets)
    return H.distinct(*H.shingles(H.span_hashes(data, starts, ends), words, width))


def shape_batches(width: int):
    """mapInArrow function: size, class, join keys and bit sketch of each text."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.slices(whole, "text"):
                values, offsets = _sets(batch, width)
                sizes = np.diff(offsets)
                text, key = _signatures(values, offsets)
                bounds = np.searchsorted(text, np.arange(len(sizes) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(H.per_text(np.add, H.mix(values ^ _CLASS_A), offsets).view(np.int64)),
                    pa.array(H.per_text(np.add, H.mix(values ^ _CLASS_B), offsets).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key.view(np.int64))),
                    pa.array(_bit_sketches(values, offsets), pa.binary()),
                ], names=["id", "n", "class_a", "class_b", "keys", "bits"])

    return shapes


def set_batches(width: int):
    """mapInArrow function: the sorted shingle hashes of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.slices(whole, "text"):
                values, offsets = _sets(batch, width)
                cuts = offsets.tolist()
                packed = [values[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(packed, pa.binary())], names=["id", "held"]
                )

    return sets


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that resemble each other, and whether their sets may be linked.

    Linked sets differ in ``(n_a + n_b) / 9`` parities at most; three times that, a
    similarity of about 0.4, is the looser bound of a family.
    """
    for batch in batches:
        most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // 9
        pairs = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
        apart = np.array([hamming(a, b) for a, b in pairs], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(apart <= most)], names=["a", "b", "close"]
        ).filter(pa.array(apart <= 3 * most))


def _family_block(group: pa.Table) -> pa.Table:
    """The pairs of a block of texts, one of them a newcomer, that may be linked."""
    sides = []
    for side in (True, False):
        part = group.filter(pc.equal(group.column("newcomer"), side))
        sides.append([part.column(c).to_numpy() for c in ("rep", "root", "n")] + [part.column("bits").to_pylist()])
    (rep_x, root_x, n_x, bits_x), (rep_y, root_y, n_y, bits_y) = sides
    main = group.column("main")[0].as_py()
    found_a, found_b = [], []
    lengths_x, lengths_y = (np.array([len(b) for b in bits], dtype=np.int64) for bits in (bits_x, bits_y))
    for long_x in np.unique(lengths_x).tolist():
        rows_x = np.flatnonzero(lengths_x == long_x)
        for long_y in np.unique(lengths_y).tolist():
            rows_y = np.flatnonzero(lengths_y == long_y)
            width = min(long_x, long_y)
            x, y = (_folded([bits[i] for i in rows], width) for bits, rows in ((bits_x, rows_x), (bits_y, rows_y)))
            strip = max(1, (1 << 24) // (y.nbytes + 1))
            for s in range(0, len(x), strip):
                i = rows_x[s:s + strip, None]
                apart = np.bitwise_count(x[s:s + strip, None, :] ^ y[None]).sum(axis=2, dtype=np.int64)
                once = (root_y[rows_y] == main) | (rep_x[i] < rep_y[rows_y])
                ok = (apart <= (n_x[i] + n_y[rows_y]) // 9) & (root_x[i] != root_y[rows_y]) & once
                u, v = np.nonzero(ok)
                found_a.append(rep_x[rows_x[s + u]])
                found_b.append(rep_y[rows_y[v]])
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, folded to ``width`` bytes."""
    rows = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(bits), -1, width // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose sets have a Jaccard similarity of 0.8 or more."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("held_a"), batch.column("held_b")):
            x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
            y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        names = {"id": side, **{c: f"{c}_{side}" for c in columns}}
        pairs = pairs.join(table.select(*(F.col(k).alias(v) for k, v in names.items())), side)
    return pairs


def _linked(near: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs ``(a, b)`` that are linked, by their exact sets.

    Only texts of these pairs are read again; a filter of fixed size picks them in the
    scan, so texts are not shuffled.
    """
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    texts = maybe_in(docs, slot_filter(ids, "id"), "id")
    sets = saved(texts.mapInArrow(set_batches(width), "id long, held binary").join(ids, "id", "left_semi"), "sets")
    return _with_sides(near, sets, "held").mapInArrow(_similar, "a long, b long").distinct()


def _shared_buckets(shapes: DataFrame, members: DataFrame) -> DataFrame:
    """``(key, rep, size)`` where at least two classes sent the key; ``size`` counts them.

    Most keys occur once. Counting 40 bits of each finds those, and a filter of
    fixed size then keeps the rows of the others from the second shuffle.
    """
    sent = shapes.select("id", F.explode("keys").alias("key"))
    sent = sent.withColumn("short", F.shiftrightunsigned("key", 24))
    repeated = sent.groupBy("short").count().where("count > 1")
    copies = members.where("id <> rep")
    rows = (
        maybe_in(sent, slot_filter(repeated, "short"), "short")
        .join(copies, "id", "left")
        .select("key", F.coalesce("rep", "id").alias("rep"))
        .distinct()
    )
    rows = saved(rows, "buckets")
    sizes = rows.groupBy("key").agg(F.count("rep").alias("size")).where("size > 1")
    return saved(rows.join(saved(sizes, "sizes"), "key"), "shared")


def _first_candidates(shared: DataFrame) -> DataFrame:
    """Each text with the hubs of its buckets.

    The hub of a bucket is its text with the most company in all its buckets: where
    many copies differ from one original, that is the original, and copies that are
    too far from each other still meet there.
    """
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    rows = shared.join(company, "rep")
    hubs = rows.groupBy("key").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub"))
    met = shared.join(saved(hubs, "hubs"), "key").where("rep <> hub")
    return met.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``rows`` with the root of their ``rep``, itself if it has none."""
    named = roots.select(F.col("node").alias("rep"), F.col("root").alias(name))
    return rows.join(named, "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def _within_families(families: DataFrame, trees: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs of one family but of different trees that may be linked.

    The texts outside a family's largest tree are compared with all of it, on a grid
    of blocks that bounds what a task holds.
    """
    rows = families.select(F.col("node").alias("rep"), F.col("root").alias("family"))
    rows = _rooted(rows, trees, "root")
    met = rows.groupBy("family", "root").count()
    main = met.groupBy("family").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("trees"),
        F.sum("count").alias("all"), (F.sum("count") - F.max("count")).alias("newcomers"),
    ).where("trees > 1")
    # written before it is joined, so that adaptive execution can split a large family
    rows = rows.join(saved(main, "mains"), "family").join(
        shapes.select(F.col("id").alias("rep"), "n", "bits").dropDuplicates(["rep"]), "rep"
    )
    columns = ["family", "main", "rep", "root", "n", "bits"]

    def grid(side: DataFrame, newcomer: bool) -> DataFrame:
        own, other = ("newcomers", "all") if newcomer else ("all", "newcomers")
        chunks = {c: F.ceil(F.col(c) / FAMILY_BLOCK).cast("int") for c in (own, other)}
        mine = F.pmod(F.xxhash64("rep"), chunks[own]).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), chunks[other] - 1))
        names = ("row", "column") if newcomer else ("column", "row")
        return side.select(*columns, mine.alias(names[0]), theirs.alias(names[1])).withColumn(
            "newcomer", F.lit(newcomer)
        )

    both = grid(rows.where("root <> main"), True).unionByName(grid(rows, False))
    return both.groupBy("family", "row", "column").applyInArrow(_family_block, "a long, b long")


def _across_families(
    shared: DataFrame, families: DataFrame, trees: DataFrame, sizes: DataFrame
) -> DataFrame:
    """Pairs of different families and trees that share as many buckets as linked texts do."""
    rows = _rooted(_rooted(shared, trees, "root"), families, "family")
    rows = rows.join(sizes.withColumnRenamed("id", "rep"), "rep")
    met = rows.groupBy("key", "family").count()
    main = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("families"), F.max_by("family", F.struct("count", "family")).alias("main")
    ).where("families > 1").drop("families")
    rows = rows.join(saved(main, "main"), "key")
    # a pair shares more than spare(min) buckets, so each side may leave some out
    skipped = F.expr("6 * (4 * n DIV 5) DIV 100")
    crowded = Window.partitionBy("rep").orderBy(F.desc("size"), "key")
    side = ("rep", "root", "family", "n", "skipped")
    rows = saved(
        rows.withColumn("crowd", F.row_number().over(crowded))
        .where(F.col("crowd") > skipped)
        .select("key", "main", "rep", "root", "family", "n", skipped.alias("skipped")),
        "open",
    )
    # the largest family of a bucket is not compared with itself
    left = rows.where("family <> main").select("key", *(F.col(c).alias(f"{c}_x") for c in side))
    right = rows.select("key", "main", *(F.col(c).alias(f"{c}_y") for c in side))
    fits = (
        (4 * F.greatest("n_x", "n_y") <= 5 * F.least("n_x", "n_y"))
        & (F.col("root_x") != F.col("root_y")) & (F.col("family_x") != F.col("family_y"))
    )
    # two small families meet twice, from either side: count them once
    once = (F.col("family_y") == F.col("main")) | (F.col("rep_x") < F.col("rep_y"))
    pairs = left.join(right, "key").where(fits & once)
    shared_least = (
        F.expr("1 + 6 * least(n_x, n_y) DIV 100") - F.greatest("skipped_x", "skipped_y")
    )
    return (
        pairs.groupBy(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
        .agg(F.count(F.lit(1)).alias("common"), F.max(shared_least).alias("least"))
        .where("common >= least")
        .select("a", "b")
    )


def link_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row of ``docs``.

    Texts are linked at a Jaccard similarity of 0.8 or more of their distinct
    ``width``-word shingles; ``component_id`` is the smallest id reachable by links.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, n long, class_a long, class_b long, keys array<long>, bits binary"
    every = saved(docs.mapInArrow(shape_batches(width), schema), "shapes")
    shapes = every.where("n > 0 AND id IS NOT NULL")

    whole = ["n", "class_a", "class_b"]
    # a table of groups is written before it is joined: an aggregate that is joined on
    # its own key leaves adaptive execution no side of the join to split
    classes = shapes.groupBy(*whole).agg(F.min("id").alias("rep"), F.count("id").alias("size"))
    classes = saved(classes.where("size > 1"), "classes")
    copies = shapes.select("id", *whole).join(classes, whole).select("id", "rep").distinct()
    members = saved(copies, "members")

    shared = _shared_buckets(shapes, members)
    sizes = shapes.select("id", "n").distinct()
    near_schema = "a long, b long, close boolean"

    def near(candidates: DataFrame) -> DataFrame:
        return _with_sides(candidates, shapes, "n", "bits").mapInArrow(_near, near_schema).distinct()

    first = saved(near(_first_candidates(shared)), "near")
    links = saved(_linked(first.where("close").select("a", "b"), docs, width), "links")
    trees, families = connected(links), connected(first.select("a", "b"))
    across = near(_across_families(shared, families, trees, sizes)).where("close").select("a", "b")
    more = saved(across.union(_within_families(families, trees, shapes)).distinct(), "near")
    copied = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = connected(links.union(_linked(more, docs, width)).union(copied))
    return (
        every.join(roots, (F.col("id") == F.col("node")) & (F.col("n") > 0), "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    )


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5
) -> DataFrame:
    """``docs`` without those that a linked one with a smaller id stands for."""
    links = link_components(docs, id_column, text_column, width)
    dropped = saved(links.where("component_id < id").select("id").distinct(), "linked")
    return without_ids(docs, id_column, dropped)
