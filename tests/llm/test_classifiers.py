"""Quality and toxicity: held-out accuracy, exact neighbours, and awkward rows."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from awkward import AWKWARD

from sondeflow.llm import labelled, quality_classifier, term_index, toxicity
from sondeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def scored(spark, name, label):
    got = QUERIES[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return got, got.merge(labels[["doc_id", label]], on="doc_id")


def test_quality_of_held_out_documents(spark):
    got, known = scored(spark, "op2_subword_quality", "quality")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_toxicity_of_held_out_documents(spark):
    got, known = scored(spark, "op7_nearest_toxic", "toxic")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = known[known.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.05


def test_labels_of_held_out_documents_are_not_learnt(spark, documents):
    """Turning every held-out label around changes no score."""
    docs = documents([(i, "good plain words here " * 3 if i % 2 else "$$$ ### junk ### $$$") for i in range(60)])
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    held = labelled.held_out("doc_id", 5, 0)
    turned = labels.withColumn("quality", (labels.quality + held.cast("int")) % 2)
    one = quality_classifier.score_quality(docs, labels).toPandas().sort_values("doc_id")
    two = quality_classifier.score_quality(docs, turned).toPandas().sort_values("doc_id")
    assert (one.score.to_numpy() == two.score.to_numpy()).all()


def test_prefixes_and_words_are_terms():
    data, offsets = toxicity.H.buffers(pa.array(["Abcdefghij", "abcdefg. x", ""]))
    hashes, texts = toxicity.term_hashes(data, offsets)
    terms = [set(hashes[texts == i].tolist()) for i in range(3)]
    assert [len(t) for t in terms] == [3, 3, 0]
    assert len(terms[0] & terms[1]) == 1  # the five-character beginning


def test_terms_are_counted_and_found_like_by_plain_search():
    rng = np.random.default_rng(11)
    texts = ["", "Abcdefghij abcdefg abcdefghijkl x", "ä" * 9 + " äääää b", "", *[
        " ".join("".join(rng.choice(list("abü"), rng.integers(1, 12))) for _ in range(rng.integers(0, 60))) for _ in range(50)
    ], ""]
    data, offsets = toxicity.H.buffers(pa.array(texts))
    hashes, owner = toxicity.term_hashes(data, offsets)
    starts, ends, _ = toxicity.H.word_spans(data, offsets, toxicity._NO_LETTER)
    some = np.arange(0, len(starts), 3)
    stops = (starts[some] + ends[some] + 1) // 2
    whole, begun = toxicity.H.beginning_hashes(data, starts, ends, [(some, stops)])
    assert (whole == toxicity.H.span_hashes(data, starts, ends)).all()
    assert (begun == toxicity.H.span_hashes(data, starts[some], stops)).all()

    pairs, times = np.unique(np.array(list(zip(owner.tolist(), hashes.tolist())), np.uint64), axis=0, return_counts=True)
    text, term, count = toxicity._counts(owner, hashes)
    assert (text == pairs[:, 0]).all() and (term == pairs[:, 1]).all() and (count == times).all()
    assert [len(x) for x in toxicity._counts(owner[:0], hashes[:0])] == [0, 0, 0]
    least, most = np.uint64(0), np.uint64(2**64 - 1)
    for vocabulary in (np.unique(term)[::2], np.arange(300, dtype=np.uint64), np.array([least, most]), term[:1]):
        sought = np.concatenate([term, vocabulary, [least, most], vocabulary + np.uint64(1)])
        found = toxicity.places(vocabulary, toxicity.begins_of(vocabulary), sought)
        assert (found == np.minimum(np.searchsorted(vocabulary, sought), len(vocabulary) - 1)).all()


def test_products_take_the_postings_of_one_text_at_a_time():
    rng = np.random.default_rng(4)
    examples, terms, texts = 2000, 3000, 40
    lists = [rng.choice(terms, 120, replace=False) for _ in range(examples)]
    bounds = np.arange(examples + 1) * 120
    counts = rng.integers(1, 5, examples * 120)
    idf = rng.uniform(0.1, 5, terms)
    index = term_index.term_index(
        np.arange(examples), bounds, np.concatenate(lists), counts, np.arange(terms, dtype=np.uint64), idf
    )
    text = np.repeat(np.arange(texts), 900)[900:]  # the first has no term
    term = np.concatenate([np.sort(rng.choice(terms, 900, replace=False)) for _ in range(texts - 1)])
    weight = rng.uniform(0.1, 3, len(term))
    matrix = index.matrix()
    assert (matrix[0] < 0).any()
    tracemalloc.start()
    found = list(index.products(matrix, text, texts, term, weight, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6  # all postings at once took 100 MB

    vectors = np.zeros((examples, terms))
    vectors[np.repeat(np.arange(examples), 120), np.concatenate(lists)] = (1 + np.log(counts)) * idf[np.concatenate(lists)]
    vectors /= np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    queries = np.zeros((texts, terms))
    queries[text, term] = weight
    assert len(found) == texts and len(found[0][0]) == 0
    for (near, products), wanted in zip(found[1:], (queries @ vectors.T)[1:]):
        assert np.allclose(products, np.sort(wanted)[::-1][:3], rtol=1e-5)
        assert np.allclose(wanted[near], products, rtol=1e-5)


def index_of(rng, examples, terms):
    idf = rng.uniform(0.1, 5, terms)
    rows = []
    for i in range(examples):
        found = rng.choice(terms, rng.integers(1, 12), replace=False)
        rows.append((i, int(rng.integers(0, 2)), found.tolist(), rng.integers(1, 9, len(found)).tolist()))
    return toxicity.build_index(rows, np.arange(terms, dtype=np.uint64), idf)


@pytest.mark.parametrize("examples", [1, 20, 64, 65, 900])
def test_neighbours_are_exact(examples):
    rng = np.random.default_rng(examples)
    index = index_of(rng, examples, 60)
    full = np.zeros((examples, 60))
    for i in range(examples):
        cut = slice(index.rows[i], index.rows[i + 1])
        full[i, index.terms[cut]] = index.weights[cut]
    text = np.repeat(np.arange(40), 5)
    term = np.concatenate([rng.choice(60, 5, replace=False) for _ in range(40)])
    queries = index.dense(text, 40, term, rng.integers(1, 5, 200))
    for query, (near, cosine) in zip(queries, index.nearest(queries, 25)):
        wanted = np.sort(full @ query)[::-1][:25]
        assert np.allclose(cosine, wanted[wanted > 0], atol=1e-5)
        assert np.allclose(full[near] @ query, cosine, atol=1e-5)


def test_nearest_are_those_of_full_vectors(spark, documents):
    """Rare terms, terms of no example and common ones all count: plain TF-IDF over all terms."""
    rng = np.random.default_rng(3)
    words = np.array([f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("st", "rq", "x")])
    share = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(3, 30), p=share / share.sum())) for _ in range(300)]
    texts[7] = "venom " + texts[7]
    texts[250] = texts[251] = "venom " + texts[250]
    texts[252] += " elsewhere unheard unheard"
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    got = toxicity.score_toxicity(documents(list(enumerate(texts))), labels).toPandas().set_index("doc_id")

    terms = [[w for word in x.split() for w in (word, *(word[:n] + "*" for n in (5, 7) if len(word) > n))] for x in texts]
    known = sorted({w for x in terms for w in x})
    counts = np.array([[x.count(w) for w in known] for x in terms], dtype=float)
    idf = np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 0.5)).clip(0)
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    examples = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    cosines = vectors @ vectors[examples].T
    for i in range(len(texts)):
        wanted = np.sort(cosines[i])[::-1][:3]
        assert np.allclose(got.similarity[i], wanted, atol=1e-5)
        assert np.allclose([cosines[i][examples.index(j)] for j in got.nearest[i]], wanted, atol=1e-5)


def test_votes_are_calibrated_by_class():
    labels, scores = np.array([1, 0]), np.array([0.5, 0.5])
    assert toxicity.vote(labels, scores, (1.0, 1.0), 0.5) == pytest.approx(0.5)
    assert toxicity.vote(labels, scores, (3.0, 1.0), 0.1) < 0.3
    assert toxicity.vote(np.zeros(0, int), np.zeros(0), (1.0, 1.0), 0.1) == pytest.approx(0.1)


@pytest.mark.parametrize("score, column", [
    (quality_classifier.score_quality, "quality"), (toxicity.score_toxicity, "toxic"),
])
def test_awkward_rows_and_labels(spark, documents, score, column):
    docs = documents(AWKWARD, "score label term predicted texts")
    labels = spark.createDataFrame(
        [(5, 1), (5, 0), (7, 1), (10, 0), (8, 1), (1, None), (None, 1), (4, 7), (99, 0)], f"doc_id long, {column} int"
    )
    got = score(docs, labels).toPandas()
    assert len(got) == len(AWKWARD) and got.score.between(0, 1).all()
    empty = score(documents([]), labels)
    assert empty.collect() == []
    none = score(docs, labels.limit(0)).toPandas()
    assert (none.score == 0).all() or (column == "quality" and (none.score < 1e-9).all())


def test_one_class_only(spark, documents):
    docs = documents([(i, f"some words number {i}") for i in range(20)])
    labels = spark.range(20).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic")
    assert (quality_classifier.score_quality(docs, labels).toPandas().score > 0.99).all()
    assert (toxicity.score_toxicity(docs, labels).toPandas().score > 0.99).all()
