"""Exact TF-IDF cosines between texts and a bounded sample, over all terms.

The commonest terms of the sample are a matrix, all others postings. A text is
multiplied with both, so no example that shares a term is passed over. Terms that no
example has change no product, only the length of the text's vector: they are counted
by shuffle and added afterwards.

Defined results: a text that shares no term with an example has none near. Equally near
examples rank by their place, that is by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import saved

#: Terms that are multiplied as a matrix: in more than a share of the examples, and at most so many.
MATRIX_SHARE, MATRIX_TERMS = 0.08, 2048

#: Texts that are multiplied with the matrix at a time.
QUERIES = 64

_POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])


class TermIndex(NamedTuple):
    """Postings of each term, ``starts`` bounds them: an example and its weight."""

    vocabulary: np.ndarray
    idf: np.ndarray
    starts: np.ndarray
    posted: np.ndarray
    ids: np.ndarray

    def weigh(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * self.idf[term]

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of each term in the matrix, or -1, and the matrix of the commonest terms."""
        size = np.diff(self.starts)
        common = np.flatnonzero(size > MATRIX_SHARE * len(self.ids))
        common = common[np.argsort(-size[common], kind="stable")][:MATRIX_TERMS]
        column = np.full(len(self.vocabulary), -1, dtype=np.int64)
        column[common] = np.arange(len(common))
        vectors = np.zeros((len(common), len(self.ids)), dtype=np.float32)
        at, owner = self._postings(common)
        posted = self.posted[at]
        vectors[owner, posted["example"]] = posted["weight"]
        return column, vectors

    def _postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of some terms, and which of these each belongs to."""
        size = self.starts[terms + 1] - self.starts[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        before = np.cumsum(size) - size
        return np.arange(len(owner)) + (self.starts[terms] - before)[owner], owner

    def products(
        self, matrix: tuple[np.ndarray, np.ndarray], text: np.ndarray, texts: int, term: np.ndarray,
        weight: np.ndarray, k: int,
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ``k`` examples of the greatest products with each text, best first.

        ``text`` ascends; every example that shares a term is multiplied.
        """
        column, vectors = matrix
        held = column[term] >= 0
        examples = len(self.ids)
        edges = np.searchsorted(text, np.arange(texts + 1))
        rare = self._sparse_products(text[~held], texts, term[~held], weight[~held])
        for first in range(0, texts, QUERIES):
            last = min(first + QUERIES, texts)
            cut = slice(edges[first], edges[last])
            row, terms, weights, dense = text[cut] - first, term[cut], weight[cut], held[cut]
            queries = np.zeros((last - first, len(vectors)), dtype=np.float32)
            queries[row[dense], column[terms[dense]]] = weights[dense]
            scores = queries @ vectors + [next(rare) for _ in range(first, last)]
            least = np.partition(scores, max(examples - k, 0), axis=1)[:, max(examples - k, 0)]
            for products, limit in zip(scores, least.tolist()):
                # equal examples may differ in the last digits
                near = np.flatnonzero((products >= limit * (1 - 1e-6)) & (products > 0))
                rounded = np.round(products[near] / max(products.max(), 1e-300), 6)
                near = near[np.argsort(-rounded, kind="stable")][:k]
                yield near, products[near]

    def _sparse_products(
        self, text: np.ndarray, texts: int, term: np.ndarray, weight: np.ndarray
    ) -> Iterator[np.ndarray]:
        """Products of each text with all examples by postings."""
        edges = np.searchsorted(text, np.arange(texts + 1)).tolist()
        # an example and its weight are fetched as one number
        posted, examples = self.posted.view(np.int64), len(self.ids)
        for first, last in zip(edges[:-1], edges[1:]):
            terms = term[first:last]
            size = self.starts[terms + 1] - self.starts[terms]
            at = np.repeat(self.starts[terms] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            found = posted.take(at, mode="clip").view(_POSTING)
            products = np.repeat(weight[first:last], size)
            products *= found["weight"]
            yield np.bincount(found["example"], products, minlength=examples)


def term_index(
    ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray
) -> TermIndex:
    """Index examples; ``bounds`` says which terms, by number, and counts belong to each."""
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    example = np.repeat(np.arange(len(ids)), np.diff(bounds))
    weights = (1 + np.log(counts)) * idf[terms]
    length = np.sqrt(np.bincount(example, weights ** 2, minlength=len(ids)))[example]
    weights = np.divide(weights, length, out=weights, where=length > 0).astype(np.float32)
    order = np.lexsort((place[example], terms))
    posted = np.empty(len(order), _POSTING)
    posted["example"], posted["weight"] = place[example[order]], weights[order]
    return TermIndex(
        vocabulary, idf, np.searchsorted(terms[order], np.arange(len(vocabulary) + 1)), posted, np.sort(ids),
    )


def other_squares(near: DataFrame, total: int) -> DataFrame:
    """``(row, rest)``: the squared length that terms of no example add to each text's vector."""
    pairs = near.select("row", F.explode(F.arrays_zip("others", "counts")).alias("pair"))
    pairs = pairs.select("row", F.col("pair.others").alias("term"), F.col("pair.counts").alias("count"))
    # most are in one document only; those in several are joined
    several = saved(pairs.groupBy("term").agg(F.count("*").alias("texts")).where("texts > 1"), "others")
    idf = F.greatest(F.log((total + 1) / (F.coalesce("texts", F.lit(1)) + 0.5)), F.lit(0.0))
    square = F.pow((1 + F.log("count")) * idf, F.lit(2.0))
    return pairs.join(several, "term", "left").groupBy("row").agg(F.sum(square).alias("rest"))
