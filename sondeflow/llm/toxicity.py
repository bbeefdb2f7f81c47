"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Terms are words and their 5- and 7-character beginnings; a term's document frequency
counts every document. A bounded sample of labelled examples is indexed twice. The
examples and similarities that are reported are those of the whole texts, over all
terms (``term_index``). The score is a vote of the nearest by telling terms only: those
that labelled toxic documents have more often, and the commonest terms as background.
Whole texts are near by topic, so their votes find fewer toxic documents. For
the vote, examples are sorted into blocks, and the index keeps
each term's largest weight per block. A query adds these up to a bound per block,
scores blocks from the highest bound on and stops when no other block can hold one
of its ``k`` nearest: the result is exact. Neighbours vote by their distance, and
votes are weighted so that they reflect the classes' shares among all labels.

Defined results: a text without telling terms, an empty or a missing one has no
voters and scores the share of toxic labels. Equally near examples rank by
their place in the index. Without any labelled example every score is 0, and without
examples of one class the score is that of the other. Labels, language, source and id
are not part of any vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .labelled import class_sizes, held_out, sampled_examples, training_labels
from .store import saved
from .term_index import TermIndex, other_squares, term_index

#: Labelled documents that are indexed, about, per class.
MOST_TOXIC, MOST_CLEAN = 2000, 4000

#: Terms that tell the classes apart, and common terms beside them.
MOST_TERMS, BACKGROUND_TERMS = 4096, 32

#: Evidence that a term needs: toxic examples with it, and log-likelihood ratio.
LEAST_EXAMPLES, LEAST_RATIO = 3, 12.0

NEIGHBOURS = 25

#: Neighbours that are reported.
EVIDENCE = 3

#: Examples in a block, and blocks that are scored for every query.
BLOCK_ROWS, HEAD_BLOCKS = 64, 8

#: Bytes of text that are scored at a time.
SCORED_BYTES = 4 << 20

_PREFIX_MARKS = {5: np.uint64(0x5851F42D4C957F2D), 7: np.uint64(0x14057B7EF767814F)}

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a batch, and the number of the text of each, which ascends per kind of term."""
    starts, ends, words = H.word_spans(data, offsets, _NO_LETTER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    at = H.characters(data)
    first = np.searchsorted(at, starts)
    inner = []
    for width in _PREFIX_MARKS:
        stop = at[np.minimum(first + width, len(at) - 1)]
        longer = np.flatnonzero(stop < ends)
        inner.append((longer, stop[longer]))
    hashes, *prefixes = H.beginning_hashes(data, starts, ends, inner)
    marked = [H.mix(prefix ^ mark) for prefix, mark in zip(prefixes, _PREFIX_MARKS.values())]
    return np.concatenate([hashes, *marked]), np.concatenate([text, *[text[longer] for longer, _ in inner]])


def _counts(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order, and how often each occurs."""
    order = np.argsort(text, kind="stable")
    text, term = text[order], term[order]
    edges = np.flatnonzero(text[1:] != text[:-1]) + 1
    # many short sorts are faster than one by two keys
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(text)]):
        term[s:e].sort()
    new = np.ones(len(text), dtype=bool)
    new[1:] = term[1:] != term[:-1]
    new[edges] = True
    first = np.flatnonzero(new)
    return text[first], term[first], np.diff(np.append(first, len(text)))


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: distinct terms and counts of each labelled example."""
    for whole in batches:
        for batch in H.slices(whole, "text"):
            data, offsets = H.buffers(batch.column("text"))
            hashes, texts = term_hashes(data, offsets)
            text, term, count = _counts(texts, hashes)
            bounds = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("label"),
                pa.ListArray.from_arrays(bounds, pa.array(term.view(np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(count, pa.int64())),
            ], names=["doc_id", "label", "terms", "counts"])


def _term_counts(batch: pa.RecordBatch, vocabulary: np.ndarray, begins: np.ndarray):
    """Counts of a batch's terms: (text, hash, count, number of the term, whether it has one)."""
    data, offsets = H.buffers(batch.column("text"))
    hashes, texts = term_hashes(data, offsets)
    text, term, count = _counts(texts, hashes)
    if not len(vocabulary):
        return text, term, count, np.zeros(len(term), np.int64), np.zeros(len(term), bool)
    place = places(vocabulary, begins, term)
    return text, term, count, place, vocabulary[place] == term


def begins_of(vocabulary: np.ndarray) -> np.ndarray:
    """Where the hashes that begin with some bits start in a sorted vocabulary, bits enough for few to each."""
    bits = max(len(vocabulary), 2).bit_length()
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.searchsorted(vocabulary, edges)


def places(vocabulary: np.ndarray, begins: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The place of each hash in the vocabulary, or that of the next one, of the last one beyond it.

    What a binary search gives; hashes are spread evenly, so a few steps from a table do.
    """
    last = len(vocabulary) - 1
    shift = np.uint64(64 - (len(begins).bit_length() - 1))
    place = np.minimum(begins[(term >> shift).view(np.int64)], last)
    behind = np.flatnonzero(vocabulary[place] < term)
    while len(behind):
        place[behind] += 1
        behind = behind[place[behind] <= last]
        behind = behind[vocabulary[place[behind]] < term[behind]]
    return np.minimum(place, last)


def frequency_batches(vocabulary: np.ndarray):
    """mapInArrow function: in how many texts of the partition each term occurs."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = begins_of(vocabulary)
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for whole in batches:
            for batch in H.slices(whole, "text"):
                *_, place, known = _term_counts(batch, vocabulary, begins)
                total += np.bincount(place[known], minlength=len(vocabulary))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(total[found])], names=["term", "texts"]
        )

    return frequencies


def _ratio(in_toxic, in_clean, toxic: int, clean: int):
    """Log-likelihood ratio of a term's presence in the two classes."""

    def fit(k, n):
        inside = F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
        return inside + F.when(k < n, (n - k) * F.log(1 - k / n)).otherwise(0.0)

    return 2 * (fit(in_toxic, toxic) + fit(in_clean, clean) - fit(in_toxic + in_clean, toxic + clean))


def choose_terms(examples: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Sorted hashes of the terms that the vectors have."""
    terms = examples.select("label", F.explode("terms").alias("term"))
    counted = terms.groupBy("term").agg(
        F.count_if(F.col("label") == 1).cast("double").alias("t"),
        F.count_if(F.col("label") == 0).cast("double").alias("c"),
    ).where("t + c >= 3")
    counted = saved(counted, "terms")
    telling = (
        counted.where((F.col("t") >= LEAST_EXAMPLES) & (F.col("t") * clean > F.col("c") * toxic))
        .withColumn("ratio", _ratio(F.col("t"), F.col("c"), toxic, clean))
        .where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS)
    )
    common = counted.orderBy(F.desc(F.col("t") + F.col("c")), "term").limit(BACKGROUND_TERMS)
    rows = telling.select("term").union(common.select("term")).distinct().collect()
    return np.sort(np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64))


class BlockMaxIndex(NamedTuple):
    """Unit vectors of the examples by row, and the largest weight per term and block."""

    vocabulary: np.ndarray
    idf: np.ndarray
    rows: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    largest: np.ndarray
    labels: np.ndarray
    ids: np.ndarray

    def dense(self, text: np.ndarray, texts: int, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """One unit vector per text from its terms' counts."""
        vectors = np.zeros((texts, len(self.vocabulary)), dtype=np.float32)
        vectors[text, term] = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return np.divide(vectors, length, out=vectors, where=length > 0)

    def _score_block(self, block: int, queries: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Cosines of some of the dense queries with the examples of a block."""
        s, e = block * BLOCK_ROWS, min((block + 1) * BLOCK_ROWS, len(self.labels))
        cut = slice(self.rows[s], self.rows[e])
        used, column = np.unique(self.terms[cut], return_inverse=True)
        vectors = np.zeros((len(used), e - s), dtype=np.float32)
        vectors[column, np.repeat(np.arange(e - s), np.diff(self.rows[s:e + 1]))] = self.weights[cut]
        return queries[some[:, None], used] @ vectors

    def nearest(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ``k`` most similar examples of each dense query and their cosines, best first.

        The blocks of the highest bounds are scored first. Only a block whose bound
        reaches the k-th best score found there can change the result.
        """
        bounds = queries @ self.largest
        blocks = bounds.shape[1]
        # no score is negative, so places that are not scored do not rank
        scores = np.zeros((len(queries), blocks, BLOCK_ROWS), dtype=np.float32)
        head = np.argpartition(-bounds, min(HEAD_BLOCKS, blocks) - 1, axis=1)[:, :HEAD_BLOCKS]
        open_ = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(open_, head, True, axis=1)

        def score() -> None:
            for block in np.flatnonzero(open_.any(axis=0)).tolist():
                rows = np.flatnonzero(open_[:, block])
                cosines = self._score_block(block, queries, rows)
                scores[rows, block, :cosines.shape[1]] = cosines

        def least_of(some: np.ndarray) -> np.ndarray:
            some = some.reshape(len(some), some.shape[1] * BLOCK_ROWS)
            cut = max(some.shape[1] - k, 0)
            return np.partition(some, cut, axis=1)[:, cut]

        score()
        least = least_of(np.take_along_axis(scores, head[:, :, None], axis=1))
        done = open_
        # sums of floats in another order differ in the last digits
        open_ = ~done & (bounds > 0) & (bounds >= least[:, None] - 1e-5)
        score()
        more = np.flatnonzero(open_.any(axis=1))
        least[more] = least_of(scores[more])
        scores = scores.reshape(len(queries), blocks * BLOCK_ROWS)
        found = []
        for row, limit in zip(scores, least):
            near = np.flatnonzero((row >= limit) & (row > 0))
            near = near[np.argsort(-row[near], kind="stable")][:k]
            found.append((near, row[near]))
        return found


def build_index(examples, vocabulary: np.ndarray, idf: np.ndarray) -> BlockMaxIndex:
    """Index ``(doc_id, label, numbers of known terms, counts)`` rows."""
    vectors = []
    for doc_id, label, terms, counts in examples:
        found, weight = unit_vector(np.array(terms, np.int64), np.array(counts, np.int64), idf)
        # examples with the same heaviest terms become neighbours, which makes bounds tight
        shape = tuple(found[np.argsort(-weight, kind="stable")][:4].tolist())
        vectors.append((label, shape, doc_id, found, weight))
    vectors.sort(key=lambda v: v[:3])
    rows = np.concatenate([[0], np.cumsum([len(v[3]) for v in vectors])]).astype(np.int64)
    blocks = -(-len(vectors) // BLOCK_ROWS)
    largest = np.zeros((len(vocabulary), blocks), dtype=np.float32)
    for i, v in enumerate(vectors):
        np.maximum.at(largest[:, i // BLOCK_ROWS], v[3], v[4])
    return BlockMaxIndex(
        vocabulary, idf, rows,
        np.concatenate([v[3] for v in vectors] or [np.zeros(0, np.int64)]),
        np.concatenate([v[4] for v in vectors] or [np.zeros(0, np.float32)]),
        largest,
        np.array([v[0] for v in vectors], dtype=np.int64),
        np.array([v[2] for v in vectors], dtype=np.int64),
    )


def unit_vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(1 + log count) * idf`` at unit length."""
    weights = (1 + np.log(counts)) * idf[terms]
    length = np.sqrt((weights ** 2).sum())
    return terms, (weights / length if length > 0 else weights).astype(np.float32)


def vote(labels: np.ndarray, scores: np.ndarray, shares: tuple[float, float], prior: float) -> float:
    """Share of the toxic votes; ``prior`` counts as one vote at the greatest distance.

    ``shares`` is how much an example of each class stands for.
    """
    votes = np.array(shares)[labels] / np.maximum(1 - scores, 1e-3)
    return float((votes[labels == 1].sum() + prior) / (votes.sum() + 1))


_SCORED = (
    "row long, doc_id long, held_out boolean, score double, nearest array<long>, products array<double>, "
    "squares double, others array<long>, counts array<long>"
)


def score_batches(shared, shares: tuple[float, float], prior: float):
    """mapInArrow function: score of each text, and the examples of the greatest products with it.

    ``squares`` is the squared length of the terms that examples have, ``others`` are all other terms.
    """

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, telling, whole_texts = shared.value
        matrix, begins = whole_texts.matrix(), begins_of(whole_texts.vocabulary)
        for whole in batches:
            for batch in H.slices(whole, "text", SCORED_BYTES):
                n = batch.num_rows
                text, term, count, place, known = _term_counts(batch, whole_texts.vocabulary, begins)
                rest = pa.array(np.searchsorted(text[~known], np.arange(n + 1)), pa.int32())
                others, other_counts = term[~known].view(np.int64), count[~known]
                text, place, count = text[known], place[known], count[known]
                out = np.full(n, prior)
                tells = telling[place] >= 0 if len(telling) else np.zeros(0, bool)
                rows, row = np.unique(text[tells], return_inverse=True)
                if len(rows):
                    queries = index.dense(row, len(rows), telling[place[tells]], count[tells])
                    for i, (found, cosine) in zip(rows.tolist(), index.nearest(queries, NEIGHBOURS)):
                        out[i] = vote(index.labels[found], cosine, shares, prior)
                evidence: list[list] = [[]] * n
                products: list[list] = [[]] * n
                weights = whole_texts.weigh(place, count) if len(place) else np.zeros(0)
                if len(place):
                    near = whole_texts.products(matrix, text, n, place, weights, EVIDENCE)
                    for i, (found, product) in enumerate(near):
                        evidence[i], products[i] = whole_texts.ids[found].tolist(), product.tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64()),
                    pa.array(evidence, pa.list_(pa.int64())), pa.array(products, pa.list_(pa.float64())),
                    pa.array(np.bincount(text, weights ** 2, minlength=n), pa.float64()),
                    pa.ListArray.from_arrays(rest, pa.array(others)),
                    pa.ListArray.from_arrays(rest, pa.array(other_counts, pa.int64())),
                ], names=[column.split()[0] for column in _SCORED.split(", ")])

    return scores


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id",
    text_column: str = "text", buckets: int = 4, remainder: int = 2, threshold: float = 0.3,
) -> DataFrame:
    """``(doc_id, held_out, score, nearest, similarity, predicted)`` of every document."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = saved(training_labels(labels, label_column, buckets, remainder), "labels")
    sizes = class_sizes(known)
    texts = sampled_examples(docs, known, sizes, {1: MOST_TOXIC, 0: MOST_CLEAN})
    schema = "doc_id long, label int, terms array<long>, counts array<long>"
    examples = saved(texts.mapInArrow(term_batches, schema), "examples")
    held = class_sizes(examples)
    toxic, clean = held.get(1, 0), held.get(0, 0)

    chosen = choose_terms(examples, max(toxic, 1), max(clean, 1))
    # only the bounded sample leaves the cluster
    sample = examples.toArrow()
    ids, labels_of = (sample.column(c).to_numpy() for c in ("doc_id", "label"))
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(sample.column("terms")).to_numpy())]).astype(np.int64)
    hashes, counts = (pc.list_flatten(sample.column(c)).to_numpy() for c in ("terms", "counts"))
    vocabulary, terms = np.unique(hashes.view(np.uint64), return_inverse=True)
    frequency = np.zeros(len(vocabulary), dtype=np.float64)
    if len(vocabulary):
        counted = docs.mapInArrow(frequency_batches(vocabulary), "term int, texts long")
        counted = counted.groupBy("term").agg(F.sum("texts").alias("texts")).toArrow()
        frequency[counted.column("term").to_numpy()] = counted.column("texts").to_numpy()
    total = docs.count()
    idf = np.log((total + 1) / (frequency + 0.5)).clip(0)

    telling = np.full(len(vocabulary), -1, dtype=np.int64)
    telling[np.searchsorted(vocabulary, chosen)] = np.arange(len(chosen))
    tells = telling[terms] >= 0
    rows = []
    for doc_id, label, s, e in zip(ids.tolist(), labels_of.tolist(), bounds[:-1], bounds[1:]):
        rows.append((doc_id, label, telling[terms[s:e][tells[s:e]]], counts[s:e][tells[s:e]]))
    voters = build_index(rows if len(chosen) else [], chosen, idf[telling >= 0])
    shared = docs.sparkSession.sparkContext.broadcast(
        (voters, telling, term_index(ids, bounds, terms, counts, vocabulary, idf))
    )

    labelled = max(sum(sizes.values()), 1)
    prior = sizes.get(1, 0) / labelled
    shares = tuple(
        sizes.get(c, 0) / labelled / (held[c] / (toxic + clean)) if held.get(c) else 0.0 for c in (0, 1)
    )
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        held_out("doc_id", buckets, remainder).alias("held_out"), "text",
    )
    scored = saved(numbered.mapInArrow(score_batches(shared, shares, prior), _SCORED), "scored")
    length = F.sqrt(F.col("squares") + F.coalesce("rest", F.lit(0.0)))
    return scored.join(other_squares(scored, total), "row", "left").select(
        "doc_id", "held_out", "score", "nearest",
        F.transform("products", lambda product: F.least(product / length, F.lit(1.0))).alias("similarity"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
