from __future__ import annotations

import pytest
from awkward import AWKWARD

from sondeflow.llm import mixing


def expected_targets(sizes: dict) -> dict:
    """Share by weight, stop at three times a source's size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


def mixed(docs):
    return {r["doc_id"]: r for r in mixing.mix(docs).collect()}


def test_targets_and_budgets(documents):
    rows = [(i, "w " * (i % 17 + 1), ["a", "b", "c", "é", "z", None, "tiny"][i % 7 if i % 50 else 6]) for i in range(4000)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] % 9 == 0]
    got = mixed(documents(rows, "size target whole threshold place"))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, text, source in rows:
        r = got[i]
        assert r["size"] == len(text.split()) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        taken[source] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 17


def test_thresholds_are_nested_and_do_not_depend_on_partitions(documents):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(500)]
    one = mixed(documents(rows).repartition(1))
    many = mixed(documents(rows).repartition(13))
    assert one == many


def test_documents_are_repeated_as_planned(documents):
    rows = [(i, "w " * (i % 5 + 1), "abc"[i % 3] if i % 10 else "d") for i in range(300)]
    docs = documents(rows, "whole times")
    plan = mixed(docs)
    copies = {}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {i: r["taken"] // r["size"] for i, r in plan.items() if r["taken"]}


def test_awkward_rows(documents):
    rows = [(i, t, s) for (i, t), s in zip(AWKWARD, [None, "b", "", "b", "é"] * 3)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_no_document_and_no_words(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed_documents(documents([])).collect() == []
    got = mixing.mix(documents([(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(documents):
    plan = mixing.mixed_documents(documents([(1, "a b", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("level", range(1, 7))
def test_documents_on_either_side_of_a_bucket_edge(spark, level):
    """Places that crowd around the edge where the budget ends, at each level."""
    edge = sum(5 << (mixing.HASH_BITS - mixing.LEVEL_BITS * k) for k in range(1, level + 1))
    near = range(-20, 20)
    places = [edge + i for i in near] + [edge + (i << 45) for i in (-3, -2, -1, 1, 2, 3)]
    rows = [("a", 50, p) for p in places] + [("b", 70, 17 * i << 40) for i in range(3 * len(places))]
    sizes = spark.createDataFrame(rows, "source string, size long, place long")
    for source in mixing.mixing_plan(sizes).collect():
        taken = sum(
            size * (source["whole"] + (place <= source["threshold"]))
            for name, size, place in rows if name == source["source"]
        )
        assert abs(taken - source["target"]) <= 70
