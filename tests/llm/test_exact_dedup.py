from __future__ import annotations

import hashlib

import pytest
from awkward import AWKWARD

from sondeflow.llm import exact_dedup, store


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_rows(documents):
    docs = documents(AWKWARD, "kept sha best group_size __x")
    rows = exact_dedup.mark_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["text_sha256"]) for r in rows), key=str) == sorted(
        ((i, sha(t)) for i, t in AWKWARD), key=str)
    stay = {}
    for r in rows:
        same = [i for i, t in AWKWARD if sha(t) == r["text_sha256"]]
        keep = max((i for i in same if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(same))
        assert not r["kept"] or r["doc_id"] == keep
        stay[r["text_sha256"]] = stay.get(r["text_sha256"], 0) + r["kept"]
    assert set(stay.values()) == {1}


def test_rows_that_repeat_id_and_text_are_all_reported(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATED_ROWS", 3)
    got = exact_dedup.mark_duplicates(documents([(1, "a")] * 10 + [(2, "a")] + [(3, "b")] * 4 + [(4, "c")])).collect()
    found = sorted((r["doc_id"], r["group_size"], r["kept"]) for r in got)
    assert found == [*[(1, 11, False)] * 10, (2, 11, True), *[(3, 4, False)] * 3, (3, 4, True), (4, 1, True)]


def test_maps_among_the_other_columns(documents):
    docs = documents([(1, "a b c"), (1, "a b c"), (2, "d")]).selectExpr("*", "map('k', rand()) AS m", "array(map(1, 2)) AS deep")
    kept = exact_dedup.keep_largest(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert exact_dedup.mark_duplicates(docs).count() == 3


def test_one_row_per_text_stays(documents):
    docs = documents(AWKWARD, "kept best sha")
    kept = exact_dedup.keep_largest(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], sha(r["text"])) for r in kept.collect()]
    wanted = {}
    for doc_id, text in AWKWARD:
        wanted[sha(text)] = max((i for i in (wanted.get(sha(text)), doc_id) if i is not None), default=None)
    assert sorted(rows, key=str) == sorted(((i, s) for s, i in wanted.items()), key=str)


def test_texts_that_only_differ_late(documents):
    start = "a" * exact_dedup.PREFIX
    docs = documents([(1, start + "x"), (2, start + "y"), (3, start + "x"), (4, start)])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.mark_duplicates(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_a_full_filter_changes_nothing(documents, monkeypatch):
    """With one slot everything collides, and the exact steps decide alone."""
    monkeypatch.setattr(exact_dedup, "SLOTS", 64)
    docs = documents([(i, f"text {i % 40}") for i in range(100)])
    got = exact_dedup.keep_largest(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60, 100))


@pytest.mark.parametrize("function", [exact_dedup.mark_duplicates, exact_dedup.keep_largest])
def test_no_document(documents, function):
    assert function(documents([])).collect() == []


def test_a_hot_group_and_its_plan(spark, documents):
    docs = documents([(i, "copy" if i % 3 else f"own {i}") for i in range(3000)])
    rows = exact_dedup.mark_duplicates(docs).collect()
    assert sum(r["kept"] for r in rows) == 1001
    plan = exact_dedup.keep_largest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filter_never_loses_a_key(spark):
    keys = spark.range(0, 3000, 3)
    found = store.maybe_in(spark.range(3000), store.slot_filter(keys, "id", slots=1 << 14), "id", slots=1 << 14)
    ids = {r["id"] for r in found.collect()}
    assert set(range(0, 3000, 3)) <= ids and len(ids) < 1300


def test_without_ids(spark, documents):
    docs = documents([(i, "t") for i in range(50)] + [(None, "t")], "id")
    left = store.without_ids(docs, "doc_id", spark.range(10))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, *range(10, 50)]
