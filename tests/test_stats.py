from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import quantiles, stats
from sondeflow.operators.quantiles import exact_quantiles, sketched_quantiles

from frames import rows


def samples():
    random = np.random.default_rng(5)
    n = 4000
    hot = random.normal(0, 1, n)
    hot[: n // 3] = 0.25
    frame = pd.DataFrame({
        "normal": random.normal(20, 5, n),
        "tailed": np.exp(random.normal(0, 6, n)),
        "signed": random.normal(0, 1e-3, n),
        "hot": hot,
        "coarse": random.integers(0, 9, n) / 2,
        "far": 1e9 + random.normal(0, 1e-3, n),
        "constant": np.full(n, 3.5),
        "holes": np.where(random.random(n) < 0.4, np.nan, random.normal(0, 1, n)),
        "nothing": np.full(n, np.nan),
    })
    frame["kind"] = np.where(random.random(n) < 0.4, "a", np.where(random.random(n) < 0.5, "b", None))
    return frame


COLUMNS = [c for c in samples().columns if c != "kind"]
PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def frame():
    return samples()


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(
        [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)],
        ", ".join(f"{c} double" for c in COLUMNS) + ", kind string",
    ).repartition(16).cache()


@pytest.mark.parametrize("accuracy, slacks, held", [
    (10_000, (2, 200, 10_000), 1 << 16),  # as it is
    (100, (2, 100), 40),                  # wide ranges, which are cut
    (100, (0, 100), 40),                  # ranges that miss a rank first
    (10_000, (10_000,), 7),               # everything is one range
])
def test_exact_quantiles_equal_a_sort(df, frame, monkeypatch, accuracy, slacks, held):
    for name, value in (("ACCURACY", accuracy), ("SLACKS", slacks), ("HELD", held), ("PIECES", 8)):
        monkeypatch.setattr(quantiles, name, value)
    found = {r["parameter"]: r for r in exact_quantiles(df, COLUMNS, PROBABILITIES).collect()}
    assert set(found) == set(COLUMNS) - {"nothing"}
    for c, row in found.items():
        values = frame[c].dropna()
        assert row["n"] == len(values)
        expected = values.quantile(PROBABILITIES).tolist()
        assert [row[f"q{i}"] for i in range(6)] == pytest.approx(expected, rel=1e-12)


def test_exact_quantiles_per_group(df, frame):
    found = exact_quantiles(df, ["tailed", "holes"], by=["kind"]).collect()
    assert len(found) == 6
    for row in found:
        mask = frame["kind"].isna() if row["kind"] is None else frame["kind"] == row["kind"]
        expected = frame.loc[mask, row["parameter"]].dropna().quantile([0.25, 0.5, 0.75]).tolist()
        assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(expected, rel=1e-12)


def test_many_groups_take_the_join_without_broadcast(df, monkeypatch):
    from sondeflow import scale
    columns = ["hot", "tailed"]
    plain = [f(df, columns, by=["kind"]) for f in (exact_quantiles, stats.box_stats)]
    plain = [sorted(rows(p), key=str) for p in plain]
    for share in (1e-4, 0.3, 0.99):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(scale, "HOT_SHARE", share)
        spread = [f(df, columns, by=["kind"]) for f in (exact_quantiles, stats.box_stats)]
        assert [sorted(rows(s), key=str) for s in spread] == plain


def test_ranges_of_probability_do_not_overlap(monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    found = np.array(quantiles._intervals([0.5, 0.25, 0.27, 1.0, 0.0], 2))
    np.testing.assert_allclose(found, [(0.0, 0.02), (0.23, 0.29), (0.48, 0.52), (0.98, 1.0)], atol=1e-12)
    assert quantiles._intervals([0.5], 100) == [(0.0, 1.0)]


@pytest.mark.parametrize("by", [[], ["kind"]])
def test_no_distribution_fills_a_window(spark, by, monkeypatch):
    """Values that share all but their last bits, a few far ones, and a hot one."""
    random = np.random.default_rng(3)
    n = 200_000
    close = 293.15 + random.uniform(0, 1e-5, n)
    close[:20] += 50
    frame = pd.DataFrame({
        "close": close, "even": random.uniform(0, 1e6, n),
        "hot": np.where(random.random(n) < 0.4, 7.25, random.normal(0, 1, n)), "kind": random.choice(["a", "b"], n),
    })
    df = spark.createDataFrame(frame).repartition(8).cache()
    for name, value in (("ACCURACY", 100), ("SLACKS", (2, 100)), ("HELD", 500)):
        monkeypatch.setattr(quantiles, name, value)
    columns = ["close", "even", "hot"]
    _, wanted = quantiles._enclosed(df, columns, (0.25, 0.5, 0.75), by)
    assert 0 < wanted.agg(F.max("different")).first()[0] <= 500
    for row in exact_quantiles(df, columns, by=by).collect():
        own = frame if not by else frame[frame.kind == row["kind"]]
        expected = own[row["parameter"]].quantile([0.25, 0.5, 0.75]).tolist()
        assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(expected, rel=1e-14)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [float("-inf"), -1.0, 0.0, 5.0, float("inf")],
                                    [-0.0, 0.0, 0.0], [1e308, -1e308, 3.0], [5e-324, 1e-310, -5e-324]])
def test_quantiles_of_few_and_extreme_values(spark, values):
    small = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(small, ["v"], [0.0, 0.5, 1.0]).first()
    ordered = sorted(values)
    middle = ordered[len(values) // 2] if len(values) % 2 else sum(ordered[:2]) / 2
    assert (row["q0"], row["q1"], row["q2"]) == (ordered[0], middle, ordered[-1])


def test_no_values_no_quantiles(df):
    assert rows(exact_quantiles(df.limit(0), COLUMNS)) == []
    assert rows(exact_quantiles(df, ["nothing"])) == []


def test_sketch_is_close(df, frame):
    found = {r["parameter"]: r for r in sketched_quantiles(df, ["normal", "nothing"]).collect()}
    assert set(found) == {"normal"}
    assert found["normal"]["q1"] == pytest.approx(frame["normal"].median(), rel=0.01)


def test_describe_matches_pandas(df, frame):
    found = stats.describe_measures(df, COLUMNS, digits=None).toPandas().set_index("parameter")
    expected = frame[COLUMNS].describe().T
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
        np.testing.assert_allclose(
            found[ours].astype(float)[COLUMNS], expected[theirs].astype(float), rtol=1e-5, atol=1e-9, equal_nan=True
        )
    assert found.loc["holes", "missing_pct"] == pytest.approx(frame["holes"].isna().mean() * 100)
    assert found.loc["nothing", "missing_pct"] == 100.0


def test_coefficient_of_variation(df, frame):
    both = df.withColumn("balanced", F.when(F.col("normal") > 20, 1.0).otherwise(-1.0) * 0)
    found = dict(rows(stats.coefficient_of_variation(both, ["normal", "tailed", "balanced"])))
    assert list(found)[0] == "tailed" and found["balanced"] is None
    assert found["normal"] == pytest.approx(frame["normal"].std() / frame["normal"].mean())


def iqr_outliers(values):
    q1, q3 = values.quantile([0.25, 0.75])
    return int(((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum())


def test_outliers_match_pandas(df, frame):
    found = dict(rows(stats.iqr_outlier_counts(df, COLUMNS)))
    assert found == {c: iqr_outliers(frame[c].dropna()) if c != "nothing" else 0 for c in COLUMNS}


def test_whiskers(spark):
    box = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "v double")
    row = stats.box_stats(box, ["v"]).first()
    assert (row["whisker_low"], row["q25"], row["q50"], row["q75"], row["whisker_high"], row["outliers"]) == (
        1.0, 3.25, 5.5, 7.75, 9.0, 1,
    )


@pytest.mark.parametrize("column", ["normal", "coarse", "hot", "holes", "constant"])
def test_histogram_matches_numpy(df, frame, column):
    counts, edges = np.histogram(frame[column].dropna(), bins=40)
    found = stats.histogram(df, [column], 40).toPandas()
    assert found["readings"].tolist() == counts.tolist()
    np.testing.assert_allclose(found["bin_from"], edges[:-1], rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(found["bin_to"], edges[1:], rtol=1e-12, atol=1e-12)


def test_correlation_matches_pandas(df, frame):
    columns = ["normal", "hot", "holes", "constant"]
    mixed = df.withColumn("mixed", F.col("hot") * 2 - F.col("holes"))
    expected = frame.assign(mixed=frame["hot"] * 2 - frame["holes"])[[*columns, "mixed"]].corr()
    for a, b, r in rows(stats.correlation_matrix(mixed, [*columns, "mixed"])):
        if np.isnan(expected.loc[a, b]):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_strongest_pair_keeps_its_sign_and_the_first_of_ties(spark):
    df = spark.createDataFrame([(float(i), -2.0 * i, 3.0 * i, 1.0) for i in range(9)], "a double, b double, c double, k double")
    a, b, r = rows(stats.strongest_correlation(df, ["a", "b", "c", "k"], digits=9))[0]
    assert (a, b, r) == ("a", "b", -1.0)
    assert rows(stats.strongest_correlation(df, ["a", "k"])) == []
    assert rows(stats.strongest_correlation(df, ["a"])) == []
    assert rows(stats.correlation_matrix(df, ["a"])) == []


@pytest.mark.parametrize("digest", ["xxhash64", "md5"])
def test_sample_is_exact_and_does_not_depend_on_partitions(spark, digest):
    df = spark.range(5000).select(F.col("id").alias("record_number"))
    picks = [
        sorted(rows(stats.reproducible_sample(df.repartition(n), 300, digest=digest))) for n in (1, 4, 32)
    ]
    assert picks[0] == picks[1] == picks[2] and len(set(picks[0])) == 300
    assert picks[0] != sorted(rows(stats.reproducible_sample(df, 300, seed=1, digest=digest)))
    assert stats.reproducible_sample(df.limit(10), 300).count() == 10


def test_ten_measures_with_holes_correlate_as_in_pandas(spark):
    random = np.random.default_rng(12)
    frame = pd.DataFrame(random.normal(0, 1, (600, 10)) @ random.normal(0, 1, (10, 10)), columns=[f"m{i}" for i in range(10)])
    frame = frame.mask(random.random(frame.shape) < 0.1)
    frame["m9"] = 4.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)],
                               ", ".join(f"{c} double" for c in frame))
    found = {(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_matrix(df, list(frame)).collect()}
    expected = frame.corr()
    assert len(found) == 100
    for (a, b), r in found.items():
        assert (r is None and "m9" in (a, b)) or r == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_nan_is_missing_everywhere(spark):
    holes = [1.0, None, 4.0, 2.0, None]
    both = [spark.createDataFrame([(None if v is None else v, float(i)) for i, v in enumerate(values)], "a double, b double")
            for values in (holes, [float("nan") if v is None else v for v in holes])]
    for function in (stats.describe_measures, stats.coefficient_of_variation, stats.correlation_matrix):
        plain, with_nan = (rows(function(df, ["a", "b"])) for df in both)
        assert plain == with_nan


def test_a_sample_passes_few_rows_on(spark):
    df = spark.range(200_000).select(F.col("id").alias("record_number"))
    samples_ = [rows(stats.reproducible_sample(df.repartition(n), 300)) for n in (1, 4, 32)]
    assert samples_[0] == samples_[1] == samples_[2] and len(samples_[0]) == 300
    plan = stats.reproducible_sample(df, 300)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "xxhash64" in plan


def test_a_sample_of_repeated_keys_is_complete(spark):
    df = spark.range(50_000).select(F.lit(7).alias("record_number"), "id")
    assert stats.reproducible_sample(df, 300).count() == 300


@pytest.mark.parametrize("width", [10, 40])
def test_correlations_take_one_scan(spark, tmp_path, width):
    random = np.random.default_rng(width)
    frame = pd.DataFrame(random.normal(0, 1, (300, width)), columns=[f"m{i}" for i in range(width)])
    path = str(tmp_path / "wide")
    spark.createDataFrame(frame).write.parquet(path)
    for function in (stats.correlation_pairs, stats.correlation_matrix, stats.strongest_correlation):
        plan = function(spark.read.parquet(path), list(frame))._jdf.queryExecution().optimizedPlan()
        assert plan.toString().count("parquet") == 1
    found = stats.correlation_pairs(spark.read.parquet(path), list(frame)).collect()
    expected = frame.corr()
    assert len(found) == width * (width - 1) // 2
    assert all(r["r"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]], abs=1e-12) for r in found)


def test_correlations_survive_large_means_and_far_subsets(spark):
    """Means of 1e9 with spreads of 1e-3, and a column that is constant where another is present."""
    random = np.random.default_rng(8)
    n = 3000
    x = random.normal(0, 1e-3, n)
    frame = pd.DataFrame({
        "far": 1e9 + x, "near": x + random.normal(0, 1e-3, n), "few": np.where(np.arange(n) % 7 == 0, x, np.nan),
        "flat": np.where(np.arange(n) % 7 == 0, 0.1, random.normal(5e3, 1, n)),
        "rare": np.where(np.arange(n) % 7 == 3, 1e6 + x, np.nan), "once": np.where(np.arange(n) == 5, 1.0, np.nan),
    })
    frame["far"] -= 1e9
    frame["far"] = (frame["far"] + 1e9)
    rows_ = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    answers_ = []
    for parts in (1, 4, 32):
        df = spark.createDataFrame(rows_, ", ".join(f"{c} double" for c in frame)).repartition(parts)
        answers_.append({(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_pairs(df, list(frame)).collect()})
    for found in answers_:
        for (a, b), r in found.items():
            both = frame[[a, b]].dropna()
            p, q = both[a] - both[a].mean(), both[b] - both[b].mean()
            if len(both) == 0 or both[a].nunique() < 2 or both[b].nunique() < 2:
                assert r is None, (a, b)
            else:
                assert r == pytest.approx((p @ q) / np.sqrt((p @ p) * (q @ q)), abs=1e-6), (a, b)
    assert answers_[0][("few", "flat")] is None and answers_[0][("few", "rare")] is None
