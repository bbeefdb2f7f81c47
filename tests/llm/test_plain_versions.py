"""Learned and permuted results against slow versions in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from awkward import AWKWARD
from tokenizers import Tokenizer

from sondeflow.llm import hashing as H, quality_classifier as Q, training_order as T
from sondeflow.llm.labelled import class_sizes, training_labels
from sondeflow.llm.queries import QUERIES, ready, table

SF = "/root/testdata/sf0.001"
WHOLE = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def plain_mix(h: int) -> int:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & WHOLE
    h = (h ^ h >> 27) * 0x94D049BB133111EB & WHOLE
    return h ^ h >> 31


def plain_hash(text: str) -> int:
    total, power = 0, 1
    for byte in text.encode():
        total, power = total + int(H.EXACT[byte]) * power, power * BASE & WHOLE
    return plain_mix((total + len(text.encode())) & WHOLE)


def plain_features(text: str | None) -> Counter:
    """How often each bucket occurs: words, words of repeated lines, and grams inside words."""
    text, shift, found = text or "", 64 - Q.BUCKET_BITS, Counter()
    seen = set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        found.update(plain_mix(plain_hash(w) ^ int(Q._WORD_MARK)) >> shift for w in words)
        if line and line in seen:
            found[int(Q._REPEAT) >> shift] += len(words)
        seen.add(line)
        for word in words:
            for width in (2, 3):
                found.update(plain_hash(word[i:i + width]) >> shift for i in range(len(word) - width + 1))
    return Counter({k: v for k, v in found.items() if v})


def test_features_equal_the_plain_ones():
    texts = [t for _, t in AWKWARD if t is None or len(t) < 1000] + ["Ab ab\nAb ab\nab Ab\n\nAb ab", "é\né", "a\tbcd\r\ne"]
    got = [Counter() for _ in texts]
    for buckets, text in Q.features(*H.buffers(pa.array(texts, pa.string()))):
        for b, t in zip(buckets.tolist(), text.tolist()):
            got[t][b] += 1
    assert got == [plain_features(t) for t in texts]


def plain_train(documents, seed=7):
    """The same descent, number by number."""
    random = np.random.default_rng(seed)
    vectors = (random.uniform(-1, 1, (1 << Q.BUCKET_BITS, Q.DIMENSIONS)).astype(np.float32) / Q.DIMENSIONS).tolist()
    output, bias = [[0.0] * Q.DIMENSIONS for _ in (0, 1)], [0.0, 0.0]
    steps, step = Q.EPOCHS * len(documents), 0
    for _ in range(Q.EPOCHS):
        for i in random.permutation(len(documents)).tolist():
            label, counts = documents[i]
            rate, step = Q.RATE * (1 - step / steps), step + 1
            n = sum(counts.values())
            average = [sum(c / n * vectors[b][d] for b, c in counts.items()) for d in range(Q.DIMENSIONS)]
            logits = [sum(o * a for o, a in zip(output[y], average)) + bias[y] for y in (0, 1)]
            largest = max(logits)
            raised = [math.exp(x - largest) for x in logits]
            error = [x / sum(raised) - (y == label) for y, x in enumerate(raised)]
            back = [sum(error[y] * output[y][d] for y in (0, 1)) for d in range(Q.DIMENSIONS)]
            for y in (0, 1):
                output[y] = [o - 0.1 * rate * error[y] * a for o, a in zip(output[y], average)]
                bias[y] -= 0.01 * rate * error[y]
            for b, c in counts.items():
                vectors[b] = [v - rate * c / n * x for v, x in zip(vectors[b], back)]
    weights = [sum((p - m) * x for p, m, x in zip(output[1], output[0], v)) for v in vectors]
    return weights, bias[1] - bias[0]


def test_training_equals_a_plain_descent(monkeypatch):
    for name, value in (("BUCKET_BITS", 5), ("DIMENSIONS", 3), ("EPOCHS", 4)):
        monkeypatch.setattr(Q, name, value)
    texts = ["good words here", "bad bad junk", "more good words", "junk $$ junk", "plain"]
    documents = [(i % 2, plain_features(t)) for i, t in enumerate(texts)]
    model = Q.train([
        (y, np.array(sorted(c), np.int32), np.array([c[b] for b in sorted(c)], np.float32)) for y, c in documents
    ])
    weights, bias = plain_train(documents)
    assert model.weights == pytest.approx(weights, rel=1e-3, abs=1e-5) and model.bias == pytest.approx(bias, abs=1e-5)


def test_quality_query_equals_plain_scores(spark):
    docs = table(ready(spark), SF, "documents").select("doc_id", "text")
    known = training_labels(table(spark, SF, "labels"), "quality", 5, 0)
    model = Q.learn(docs, known, class_sizes(known))
    got = {r["doc_id"]: r for r in QUERIES["op2_subword_quality"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        counts = plain_features(text)
        if len(text or "") > 20_000 or not counts:
            continue
        odds = sum(float(model.weights[b]) * c for b, c in counts.items()) / sum(counts.values()) + model.bias
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-5)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def plain_slot(number: int, size: int, key: int) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = [plain_mix((BASE * i & WHOLE) ^ key) for i in range(1, T.ROUNDS + 1)]
    while True:
        left, right = number >> half, number & mask
        for k in keys:
            left, right = right, left ^ (plain_mix(right ^ k) & mask)
        number = left << half | right
        if number < size:
            return number


def test_order_query_equals_a_plain_one(spark):
    """Every document's pieces, with lengths and checksums, in the slots of a plain permutation."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = QUERIES["op4_training_order"](spark, SF).collect()
    expected = {}
    for d in table(spark, SF, "documents").collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), T.LENGTH)):
            own = np.array(ids[at:at + T.LENGTH], "<u2").tobytes()
            expected[d["doc_id"], piece] = (len(own) // 2, zlib.crc32(own), own.ljust(2 * T.LENGTH, b"\0"))
    assert len(rows) == len(expected)
    for r in rows:
        assert (r["n_tokens"], r["ids_crc32"], bytes(r["tokens"])) == expected[r["doc_id"], r["piece"]]
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // T.PER_SHARD, r["slot"] % T.PER_SHARD * 2 * T.LENGTH)
    number = {plain_slot(n, len(rows), 0x5EED): n for n in range(len(rows))}
    assert len(number) == len(rows)
    order = [(r["doc_id"], r["piece"]) for r in sorted(rows, key=lambda r: number[r["slot"]])]
    # numbers follow the input: the pieces of a document are neighbours, in their order
    assert all(b[1] == 0 or b == (a[0], a[1] + 1) for a, b in zip(order, order[1:]))


def test_ids_beyond_16_bits_are_refused(spark, documents):
    with pytest.raises(Exception, match="does not fit 16 bits"):
        T.training_order(documents([(1, "a")]), public_tokenizers.path("byte_bpe_50k.json"), 1, closing_id=70_000).collect()
