"""Supervised subword embeddings: a document's quality from averaged hashed vectors.

Words and character 2- and 3-grams inside words, with their case, are hashed into
buckets, and every bucket has a learned vector. A document is the average of the
vectors of all its features, followed by a softmax layer. Words of a line that
repeats an earlier one count as one more feature each, so that an average can see
repetition. Training is stochastic gradient descent in numpy, document by document,
on a bounded sample of labelled documents, whose feature counts (at most one per
bucket) are all that leaves the cluster. The output layer is linear in the average,
so for scoring the model is one number per bucket, which is broadcast; every
document is scored on its whole text in the scan.

Defined results: a missing or empty text has no feature and scores the share of
label 1. Without labelled documents every score is 0, with labels of one class it is
that class. Repeated rows and ids are scored each on their own. Labels, language,
source and id are not features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .labelled import class_sizes, held_out, sampled_examples, training_labels
from .store import saved

#: Labelled documents of each class that are learnt from, about.
MOST_GOOD, MOST_BAD = 3000, 2000

#: Buckets of the vectors, and their length.
BUCKET_BITS, DIMENSIONS = 17, 12

EPOCHS, RATE = 12, 6.0

_GRAMS = (2, 3)
_WORD_MARK, _REPEAT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _repeated_line_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the words in lines that an earlier line of the text equals."""
    first, last, lines = H.word_spans(data, offsets, _NEWLINE)
    hashes = H.span_hashes(data, first, last, H.EXACT)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    order = np.lexsort((hashes, text))
    again = np.zeros(len(first), dtype=bool)
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[order[1:][same]] = True
    line = np.searchsorted(first, starts, side="right") - 1
    return np.flatnonzero(again[line]) if len(first) else np.zeros(0, np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kind by kind: the bucket of each feature, and the number of its text, ascending."""
    shift = np.uint64(64 - BUCKET_BITS)
    starts, ends, words = H.word_spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    yield (H.mix(H.span_hashes(data, starts, ends, H.EXACT) ^ _WORD_MARK) >> shift).astype(np.int32), text
    again = _repeated_line_words(data, offsets, starts)
    yield np.full(len(again), int(_REPEAT >> shift), dtype=np.int32), text[again]
    at = H.characters(data)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    spaces = np.concatenate([[0], np.cumsum(H.SPACE[data[at[:-1]]])])
    for width in _GRAMS:
        if len(owner) < width:
            continue
        whole = (spaces[width:] == spaces[:-width]) & (owner[width - 1:] == owner[:len(owner) - width + 1])
        s = np.flatnonzero(whole)
        yield (H.span_hashes(data, at[s], at[s + width], H.EXACT) >> shift).astype(np.int32), owner[s]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: bucket counts of each labelled document."""
    for whole in batches:
        for batch in H.slices(whole, "text"):
            found = list(features(*H.buffers(batch.column("text"))))
            keys = np.concatenate([(t.astype(np.int64) << BUCKET_BITS) | b for b, t in found])
            keys, counts = np.unique(keys, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.int64) << BUCKET_BITS)
            buckets = (keys & ((1 << BUCKET_BITS) - 1)).astype("<i4")
            shares, cuts = counts.astype("<f4"), bounds.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("label"),
                pa.array([buckets[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])], pa.binary()),
                pa.array([shares[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ], names=["doc_id", "label", "buckets", "counts"])


class Model(NamedTuple):
    """Log-odds of label 1 per bucket, and the constant."""

    weights: np.ndarray
    bias: float


def train(documents: list[tuple[int, np.ndarray, np.ndarray]], log_odds: float = 0.0, seed: int = 7) -> Model:
    """Learn vectors and output layer from ``(label, buckets, counts)`` documents.

    ``log_odds`` is added to the constant, for a sample whose classes are not as
    frequent as in the corpus.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    documents = [(y, b, (c / c.sum()).astype(np.float32)) for y, b, c in documents if len(b)]
    steps, step = max(EPOCHS * len(documents), 1), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(documents)).tolist():
            label, buckets, shares = documents[i]
            rate = RATE * (1 - step / steps)
            step += 1
            average = shares @ vectors[buckets]
            logits = output @ average + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = error @ output
            output -= 0.1 * rate * np.outer(error, average)
            bias -= 0.01 * rate * error
            vectors[buckets] -= rate * np.outer(shares, back)
    return Model(
        (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]) + log_odds
    )


def score_batches(shared, prior: float):
    """mapInArrow function: probability of label 1 of each text."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for whole in batches:
            for batch in H.slices(whole, "text"):
                total = np.zeros(batch.num_rows)
                count = np.zeros(batch.num_rows)
                for buckets, text in features(*H.buffers(batch.column("text"))):
                    total += np.bincount(text, model.weights[buckets], batch.num_rows)
                    count += np.bincount(text, minlength=batch.num_rows)
                odds = np.clip(total / np.maximum(count, 1) + model.bias, -40, 40)
                score = np.where(count > 0, 1 / (1 + np.exp(-odds)), prior)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
                    names=["doc_id", "held_out", "score"],
                )

    return scores


def learn(docs: DataFrame, known: DataFrame, sizes: dict[int, int]) -> Model:
    """A model from the bounded sample of ``known (doc_id, label)``."""
    texts = sampled_examples(docs, known, sizes, {1: MOST_GOOD, 0: MOST_BAD})
    counted = texts.mapInArrow(count_batches, "doc_id long, label int, buckets binary, counts binary")
    rows = sorted(saved(counted, "examples").collect(), key=lambda r: (r["doc_id"], r["buckets"]))
    documents = [
        (r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in rows
    ]
    held = [sum(d[0] == c for d in documents) for c in (0, 1)]
    shift = 0.0
    if all(held):
        shift = float(np.log(sizes[1] / sizes[0]) - np.log(held[1] / held[0]))
    return train(documents, shift)


def score_quality(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
    text_column: str = "text", buckets: int = 5, remainder: int = 0, threshold: float = 0.3,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = saved(training_labels(labels, label_column, buckets, remainder), "labels")
    sizes = class_sizes(known)
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) == 2:
        model = learn(docs, known, sizes)
    else:
        model = Model(np.zeros(1 << BUCKET_BITS, np.float32), 40.0 if prior else -40.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", held_out("doc_id", buckets, remainder).alias("held_out"), "text").mapInArrow(
        score_batches(shared, prior), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
