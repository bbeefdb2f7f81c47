from __future__ import annotations

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from sondeflow.llm import whitening as W
from sondeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain(vectors: list[list[float]], most: int):
    """Fit list, eigenvalues and components by numpy on exact centred numbers."""
    x = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total)] for v in x])
    v = y.T @ y / n
    values, units = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return n, total, values[order], units[:, order], values.sum()


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (16, 9), (40, 40)])
def test_components_equal_an_eigendecomposition(d, rank):
    random = np.random.default_rng(d)
    a = random.normal(size=(d, rank)) * np.logspace(0, -4, rank)
    v = a @ a.T
    values, units = W.principal_components(v, d)
    wanted = np.linalg.eigvalsh(v)[::-1][:rank]
    assert len(values) == rank
    # the yardstick itself is exact to the largest value only
    assert np.allclose(values, wanted, rtol=1e-9, atol=1e-13)
    assert np.abs(units.T @ units - np.eye(rank)).max() < 1e-8
    assert np.abs(units * values @ units.T - v).max() < 1e-13


def test_no_digits_are_lost_on_a_graded_matrix():
    scale = np.logspace(0, -7, 8)
    v = np.outer(scale, scale) * (np.eye(8) + 0.1)
    values, units = W.principal_components(v, 8)
    assert np.abs((units / np.sqrt(values)).T @ v @ (units / np.sqrt(values)) - np.eye(8)).max() < 1e-9


def test_every_two_columns_meet_once():
    for n in range(1, 10):
        met = sorted(tuple(sorted(p)) for a, b in W._rounds(n) for p in zip(a.tolist(), b.tolist()))
        assert met == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_scatter_is_exact():
    random = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 27, 1 << 30, 1 << 40):
        x = random.integers(-most, most, (50, 3))
        wanted = x.astype(object).T @ x.astype(object)
        assert (W.scatter(x).astype(object) == wanted).all()


def test_query_equals_plain_whitening(spark):
    got = QUERIES["op12_pivoted_whitening"](spark, SF).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    n, total, values, units, trace = plain([v for _, v in rows], 16)
    assert len(got) == 16 * len(rows)
    by_row = {(r["vec_id"], r["component"]): r for r in got}
    mine = {}
    for i, v in rows:
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total))
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total)])
        for k in range(16):
            r = by_row[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
            assert r["identity_error"] < 1e-10
            mine.setdefault(k, []).append((r["whitened"], y @ units[:, k] / math.sqrt(values[k])))
    for k, pairs in mine.items():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_rows_that_are_left_out_repeated_or_of_another_width(spark):
    random = np.random.default_rng(3)
    good = [(i, random.normal(size=5).tolist(), i) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, 0), (101, [1.0, None, 1.0, 1.0, 1.0], 0), (102, [nan, 1.0, 1.0, 1.0, 1.0], 0),
           (103, [1.0, inf, 1.0, 1.0, 1.0], 0), (104, [1.0, -inf, 1.0, 1.0, 1.0], 0), (105, [], 0)]
    other = [(200, [1.0, 2.0], 0), (201, [2.0, 2.0], 0), (202, [5.0, 1.0], 1), (203, [7.0], 1)]
    again = [good[0], good[0], (None, good[1][1], 9)]
    df = vectors(spark, good + bad + other + again).selectExpr("*", "1 AS component", "'x' AS n", "0 AS x")
    got = W.whiten(df, components=3).collect()
    counts = {}
    for r in got:
        counts[r["id"]] = counts.get(r["id"], 0) + 1
    assert counts == {0: 9, None: 3, **{i: 3 for i in range(1, 40)}, 200: 2, 201: 2, 202: 2}
    assert {r["n"] for r in got if r["id"] in (0, None)} == {40}
    assert {r["n"] for r in got if r["id"] == 200} == {3}
    assert all(r["identity_error"] < 1e-10 for r in got)
    hot = W.whiten(vectors(spark, good + [(500 + i, good[3][1], 0) for i in range(200)]), components=2)
    assert {r["n"] for r in hot.collect()} == {40}


def test_huge_constant_and_missing_vectors(spark):
    rows = [(1, [1e30, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [5.0, 0.5], 0), (4, [0.0, 0.25], 0)]
    assert len(W.whiten(vectors(spark, rows)).collect()) in (4, 8)
    assert W.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    assert W.whiten(vectors(spark, [])).collect() == []


def test_partitions_do_not_change_the_fit(spark):
    random = np.random.default_rng(4)
    df = vectors(spark, [(i, random.normal(size=6).tolist(), 0) for i in range(300)])
    one, many = (
        {(r["id"], r["component"]): (r["n"], r["deviation"], round(r["whitened"], 9)) for r in
         W.whiten(df.repartition(n)).collect()} for n in (1, 13)
    )
    assert one == many
