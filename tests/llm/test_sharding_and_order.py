from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from awkward import AWKWARD
from tokenizers import Tokenizer

from sondeflow.llm import sharding, training_order

PATH = public_tokenizers.path("byte_bpe_50k.json")
NAMES = [f"s{i}" for i in range(13)]


def test_slots_are_even_and_every_one_is_owned():
    owner = sharding.lookup_table(NAMES, 1009)
    counts = np.bincount(owner, minlength=13)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1


def test_few_slots_move_when_a_shard_goes():
    before = np.array(NAMES)[sharding.lookup_table(NAMES, 4099)]
    left = NAMES[:5] + NAMES[6:]
    after = np.array(left)[sharding.lookup_table(left, 4099)]
    moved = (before != after) & (before != NAMES[5])
    assert moved.mean() < 0.15


@pytest.mark.parametrize("names, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_placing_awkward_rows(documents):
    docs = documents(AWKWARD, "slot shard other")
    placed = sharding.place(docs, "doc_id", NAMES)
    rows = placed.collect()
    assert len(rows) == len(AWKWARD) and placed.columns.count("shard") == 1
    owner = sharding.lookup_table(NAMES)
    assert all(r["shard"] == NAMES[owner[r["slot"]]] for r in rows)
    assert sharding.place(documents([]), "doc_id", NAMES).collect() == []


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    docs = documents([(i, f"t{i}") for i in range(200)])
    sharding.write_shards(docs, "doc_id", NAMES, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(200))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 100, 1023, 1024, 1025, 70_000])
def test_permutation_is_one_to_one_and_has_an_inverse(size):
    numbers = np.arange(size)
    there = training_order.permuted(numbers, size, key=99)
    assert sorted(there.tolist()) == numbers.tolist()
    assert (training_order.permuted(there, size, key=99, back=True) == numbers).all()
    if size > 100:
        assert (there != training_order.permuted(numbers, size, key=98)).mean() > 0.9


def test_shards_round_trip(spark, documents, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {i: f"sequence number {i} of some words " * (i % 9) for i in range(300)}
    ordered = training_order.training_order(documents(list(texts.items())), PATH, key=5, length=16, per_shard=100)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
    training_order.write_shards(ordered, str(tmp_path / "shards"))
    by_slot = {r["slot"]: r for r in rows}
    found = {}
    for shard in range(-(-len(rows) // 100)):
        folder = tmp_path / "shards" / f"shard={shard}"
        files = [f for f in folder.iterdir() if f.name.startswith("part-")]
        assert len(files) == 1
        raw = files[0].read_bytes()
        records = training_order.read_shard(spark, str(tmp_path / "shards"), shard, 16).collect()
        for nth, record in enumerate(records):
            row = by_slot[shard * 100 + nth]
            # a reader finds the record with one seek
            assert raw[nth * 33:nth * 33 + 32] == record == bytes(row["tokens"])
            assert row["byte_offset"] == nth * 32
            ids = np.frombuffer(record, "<u2")[:row["n_tokens"]].tolist()
            found[row["doc_id"], row["piece"]] = ids
    for i, text in texts.items():
        ids = [x for piece in sorted(p for d, p in found if d == i) for x in found[i, piece]]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_order_of_awkward_rows(documents):
    docs = documents(AWKWARD, "slot task nth tokens")
    rows = training_order.training_order(docs, PATH, key=1).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert {r["doc_id"] for r in rows} == {r[0] for r in AWKWARD}
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert training_order.training_order(documents([]), PATH, key=1).collect() == []
