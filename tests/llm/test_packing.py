from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from awkward import AWKWARD
from tokenizers import Tokenizer

from sondeflow.llm import packing, tokens
from sondeflow.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected_pieces(tokenizer, text, capacity=2048):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    return [
        (i, s, e - s, zlib.crc32(ids[s:e].tobytes()))
        for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))
    ]


def assert_packed(rows, capacity=2048):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_equals_plain_tokenizing(spark, tokenizer):
    rows = QUERIES["op9_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {
        d["doc_id"]: expected_pieces(tokenizer, d["text"]) for d in docs
    }
    # no packing can do with less than the sum of all lengths asks for
    assert assert_packed(rows) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a  b   c", " lead", "trail  ", "don't we'll O'Neil 'sword", "x<|endoftext|> y <|endoftext|>z",
    "é. É, ×. ÷, a×b", "a b c　d  e", "1234 5,678.9", "tab\tnew\r\nline \x1c \x85 end", "ñ'ñ ǆ. Ω. я, 日本 語.",
    "😀 😀. a😀 .b", "!!! ??", "word." * 50,
])
def test_cut_texts_encode_alike(tokenizer, text):
    import pyarrow as pa

    ids, offsets = tokens.Encoder(PATH).encode(pa.array(["before ", text, None, text]))
    wanted = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[offsets[1]:offsets[2]].tolist() == wanted
    assert offsets[2] == offsets[3] and ids[offsets[3]:].tolist() == wanted


def test_random_texts_encode_alike(tokenizer):
    import pyarrow as pa

    rng = random.Random(2)
    alphabet = "ab Z09 .,'!-\n\té×÷ñ  日😀<|>_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    ids, offsets = tokens.Encoder(PATH).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in room if r >= length]
        if fitting:
            room.remove(best := min(fitting))
            room.append(best - length)
        else:
            room.append(capacity - length)
    return sorted(room)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 7, 16, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for run in packing.best_fit_runs(counts, capacity):
            for nth in range(run.count):
                sequence, offset = run.sequence + nth // run.each, run.offset + nth % run.each * run.length
                assert used.get(sequence, 0) == offset
                used[sequence] = offset + run.length
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)


def test_tree_finds_the_tightest():
    rng = random.Random(9)
    tree, present = packing.CapacityTree(40), set()
    for _ in range(2000):
        room = rng.randint(1, 40)
        (present.discard if room in present else present.add)(room)
        tree.mark(room, room in present)
        least = rng.randint(1, 40)
        assert tree.tightest(least) == min((r for r in present if r >= least), default=None)


def test_awkward_rows(documents, tokenizer):
    docs = documents(AWKWARD, "length rank salt piece ids")
    rows = packing.pack_documents(docs, PATH).collect()
    assert_packed(rows)
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows if r["doc_id"] in (1, 2, 12)) == [(1, 1), (2, 1), (12, 1)]
    assert len([r for r in rows if r["doc_id"] == 6]) == 2
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 8) == expected_pieces(
        tokenizer, dict(AWKWARD)[8])


def test_no_document(documents):
    assert packing.pack_documents(documents([]), PATH).collect() == []


def test_sequences_hold_the_ids(documents, tokenizer):
    texts = {i: f"some words of text number {i} " * (i % 7 + 1) for i in range(60)}
    pieces = packing.cut_documents(documents(list(texts.items())), PATH, 64, with_ids=True)
    packed = packing.pack(pieces, 64)
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    back = {}
    for r in packed.orderBy("piece").collect():
        cut = held[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        back.setdefault(r["doc_id"], []).extend(cut)
    assert back == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
