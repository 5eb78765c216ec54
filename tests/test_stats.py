"""Statistics on hand-made tables, against numpy and pandas formulas."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkassay.operators import series, stats

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_r_squared(spark, value):
    t = frame(spark, y=[1.0, 2.0, 3.0], p=[1.0, 2.0, 4.0], c=[5.0, 5.0, 5.0], far=[9.0, 9.0, 9.0])
    assert value(stats.r_squared(t, "y", "p")) == pytest.approx(0.5)
    assert value(stats.r_squared(t, "y", "far")) < 0
    assert value(stats.r_squared(t, "c", "y")) == 0.0
    assert value(stats.r_squared(t.where("y > 9"), "y", "p")) == 0.0


def test_inflation_edges(spark, value):
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = x1 - 2 * x2 + rng.normal(size=200)
    t = frame(spark, y=y, x1=x1, x2=x2, x3=x1 + x2, k=np.ones(200), s=["a"] * 200)
    design = np.column_stack([np.ones(200), x1, x2])
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for others in (["x1", "x2"], ["x1", "x2", "x3"], ["x1", "x2", "k"]):
        assert value(stats.variance_inflation_factor(t, "y", others)) == pytest.approx(1 / (1 - r2), rel=1e-9)
    assert value(stats.variance_inflation_factor(t, "x3", ["x1", "x2"])) == math.inf
    assert value(stats.variance_inflation_factor(t, "absent")) == 0.0
    assert value(stats.variance_inflation_factor(t.select("y", "s"), "y")) == 1.0
    assert value(stats.variance_inflation_factor(t, "y", ["s"])) == 1.0
    assert value(stats.variance_inflation_factor(t.limit(1), "y", ["x1"])) == 1.0


def test_inflation_with_missing_cells(spark, value):
    t = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (2.0, 1.0, None), (3.0, 5.0, 2.0), (4.0, 2.0, 7.0), (5.0, 9.0, 1.0)],
        "y double, a double, b double",
    )
    kept = np.array([(1, 2, 1), (3, 5, 2), (4, 2, 7), (5, 9, 1)], dtype=float)
    design = np.column_stack([np.ones(4), kept[:, 1:]])
    fit = design @ np.linalg.lstsq(design, kept[:, 0], rcond=None)[0]
    r2 = 1 - ((kept[:, 0] - fit) ** 2).sum() / ((kept[:, 0] - kept[:, 0].mean()) ** 2).sum()
    # a missing predictor drops the row, a missing value of the column itself breaks the fit
    assert value(stats.variance_inflation_factor(t, "y", ["a", "b"])) == pytest.approx(1 / (1 - r2))
    assert value(stats.variance_inflation_factor(t, "b", ["a", "y"])) == 1.0
    both = {r["column"]: r["value"] for r in stats.variance_inflation_factors(t).collect()}
    assert both["b"] == 1.0 and both["y"] == pytest.approx(1 / (1 - r2))


def psi(e, a, bins):
    edges = np.linspace(min(e.min(), a.min()), max(e.max(), a.max()), bins + 1)
    e, a = (np.histogram(x, bins=edges)[0] + 1e-10 for x in (e, a))
    e, a = e / e.sum(), a / a.sum()
    return float(np.sum((a - e) * np.log(a / e)))


@few
@given(
    st.lists(st.integers(-20, 20), min_size=1, max_size=60),
    st.lists(st.integers(-25, 15), min_size=1, max_size=60),
    st.sampled_from([1, 3, 10, 40]),
    st.sampled_from([1.0, 0.1, 1e-7]),
)
def test_drift_against_numpy(spark, value, e, a, bins, scale):
    e, a = np.array(e) * scale, np.array(a) * scale
    got = value(stats.population_stability_index(frame(spark, v=e), "v", frame(spark, v=a), "v", bins))
    assert got == pytest.approx(psi(e, a, bins), rel=1e-9, abs=1e-9)
    assert got >= -1e-12


def test_drift_edges(spark, value):
    t = frame(spark, v=[1.0, 2.0, 3.0])
    assert value(stats.population_stability_index(t, "v", t, "v")) == pytest.approx(0.0)
    assert value(stats.population_stability_index(t, "v", t.where("v > 9"), "v")) == 0.0
    same = frame(spark, v=[4.0, 4.0])
    assert value(stats.population_stability_index(same, "v", same, "v")) == pytest.approx(0.0)


def test_leakage(spark, value):
    n = 40
    x = np.arange(n, dtype=float)
    t = frame(
        spark, y=x, same=x * 3 + 1, down=-x, noise=np.tile([0.0, 1.0], n // 2), k=np.ones(n),
        text=[str(i) for i in range(n)], two=[1.0, 2.0] + [np.nan] * (n - 2),
    )
    assert value(stats.target_leakage_count(t, "y")) == 2
    assert value(stats.target_leakage_count(t, "y", ["same", "text", "two", "absent"])) == 2
    assert value(stats.target_leakage_count(t, "y", ["noise"], 0.0)) == 1
    assert value(stats.target_leakage_count(t, "absent")) == 0
    assert value(stats.potential_target_leakage_candidate_count(t, "k")) == 0


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [("a", 1, "yes"), ("a", 0, "no"), ("b", 1, "yes"), ("b", None, None), ("b", 0, "no"), ("b", 0, "no"), (None, 1, "yes")]
    return spark.createDataFrame(rows, "grp string, outcome int, said string")


def test_parity(outcomes, value):
    assert value(stats.demographic_parity_disparity(outcomes, "grp", "outcome")) == 0.25
    assert value(stats.demographic_parity_disparity(outcomes, "grp", "said", "yes")) == 0.25
    assert value(stats.demographic_parity_disparity(outcomes, "grp", "said")) == 0.0
    assert value(stats.demographic_parity_disparity(outcomes.where("grp = 'a'"), "grp", "outcome")) == 0.0
    assert value(stats.demographic_parity_disparity(outcomes, "grp", "absent")) == 0.0


def test_imbalance(outcomes, value):
    assert value(stats.class_imbalance_ratio(outcomes, "grp")) == 2.0
    assert value(stats.class_imbalance_ratio(outcomes.where("grp = 'a'"), "grp")) == 1.0
    assert value(stats.class_imbalance_ratio(outcomes.limit(0), "grp")) == 1.0
    assert value(stats.class_imbalance_ratio(outcomes, "absent")) == 0.0


def rolling_score(v):
    v = np.asarray(v, dtype=float)
    if len(v) < 3:
        return 0.0
    rolled = pd.Series(v).rolling(max(2, len(v) // 5), center=True)
    mean, spread = rolled.mean().to_numpy(), rolled.std().to_numpy()
    with np.errstate(invalid="ignore"):
        return min(float(np.mean((v > mean + 2 * spread) | (v < mean - 2 * spread))), 1.0)


@pytest.mark.parametrize("window_rows", [1_000_000, 5])
def test_change_points_against_pandas(spark, window_rows):
    rng = np.random.default_rng(2)
    walk = {
        "two": [1.0, 2.0],
        "seven": rng.normal(size=7),
        "spike": np.where(np.arange(50) == 25, 100.0, rng.normal(size=50)),
        "odd": np.exp(rng.normal(size=203) * 2),
        "even": np.exp(rng.normal(size=210) * 2) + 1e6,
        "gap": np.where(np.arange(120) == 60, np.nan, np.exp(rng.normal(size=120) * 2)),
        "constant": np.full(40, 3.5),
    }
    rows = [(k, i, float(x)) for k, xs in walk.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    t = spark.createDataFrame([(r[0], int(r[1]), float(r[2])) for r in rows], "key string, t bigint, v double")
    got = {r["key"]: r for r in series.change_point_scores(t, ["key"], "t", "v", window_rows).collect()}
    for key, xs in walk.items():
        assert got[key]["points"] == len(xs)
        assert got[key]["value"] == pytest.approx(rolling_score(xs)), key


@pytest.mark.parametrize("window_rows", [1_000_000, 100])
def test_change_points_of_one_series(spark, value, window_rows):
    xs = np.exp(np.random.default_rng(8).normal(size=3000) * 2)
    t = spark.createDataFrame(pd.DataFrame({"t": np.arange(3000), "v": xs})).repartition(5)
    score = value(series.change_point_detection_score(t, "t", "v", window_rows))
    assert score == pytest.approx(rolling_score(xs)) and score > 0
    assert value(series.change_point_detection_score(t.where("t < 0"), "t", "v", window_rows)) == 0.0


def exact_score(v):
    """The score in rational numbers, window by window."""
    n, hits = len(v), 0
    w = max(2, n // 5)
    ahead = (w - 1) // 2
    behind = w - 1 - ahead
    for i in range(behind, n - ahead):
        window = [Fraction(float(x)) for x in v[i - behind : i + ahead + 1]]
        mean = sum(window) / w
        hits += (Fraction(float(v[i])) - mean) ** 2 > 4 * sum((x - mean) ** 2 for x in window) / (w - 1)
    return hits / n


@pytest.mark.parametrize("spike", [0.0, 1e9, 1e12])
def test_spikes_touch_only_their_windows(spark, value, spike):
    xs = np.random.default_rng(0).normal(size=600)
    xs[[0, 300]] += spike
    t = spark.createDataFrame(pd.DataFrame({"t": np.arange(600), "v": xs})).repartition(5)
    for window_rows, piece in ((2_000_000, 250_000), (100, 250_000), (2_000_000, 17), (100, 13)):
        assert value(series.change_point_detection_score(t, "t", "v", window_rows, piece)) == exact_score(xs)


def test_equal_and_infinite_points(spark, value):
    for xs in (np.full(50, 0.1), np.full(50, 1e15 + 0.3)):
        t = spark.createDataFrame(pd.DataFrame({"t": np.arange(50), "v": xs}))
        assert value(series.change_point_detection_score(t, "t", "v", piece=4)) == 0.0
    xs = np.where(np.arange(50) == 20, np.inf, np.random.default_rng(1).normal(size=50))
    t = spark.createDataFrame(pd.DataFrame({"t": np.arange(50), "v": xs}))
    assert value(series.change_point_detection_score(t, "t", "v")) <= 0.2


def test_inflation_of_many_columns(spark):
    """Above the columns that are written out pair by pair; with a constant, a gap and a copy."""
    x = np.random.default_rng(1).normal(size=(500, 40))
    x[:, 0] += x[:, 1] * 2 + 1e6
    x[:, 39] = 3.0
    names = [f"c{i}" for i in range(40)]
    t = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(8)
    got = {r["column"]: r["value"] for r in stats.variance_inflation_factors(t).collect()}
    inverse = np.linalg.inv(np.corrcoef(x[:, :-1].T))
    assert got["c39"] == math.inf
    assert all(got[f"c{i}"] == pytest.approx(inverse[i, i], rel=1e-9) for i in range(39))
    copied = t.withColumn("copy", F.col("c5") * 2 + 1)
    got = {r["column"]: r["value"] for r in stats.variance_inflation_factors(copied).collect()}
    assert got["copy"] == got["c5"] == math.inf and got["c7"] == pytest.approx(inverse[7, 7], rel=1e-6)
    gap = t.withColumn("c3", F.when(F.col("c4") > 2, F.lit(None)).otherwise(F.col("c3")))
    got = {r["column"]: r["value"] for r in stats.variance_inflation_factors(gap).collect()}
    kept = x[x[:, 4] <= 2][:, :-1]
    assert got["c3"] == 1.0 and got["c0"] == pytest.approx(np.linalg.inv(np.corrcoef(kept.T))[0, 0], rel=1e-9)
    assert {r["value"] for r in stats.variance_inflation_factors(t.limit(1)).collect()} == {1.0}


def test_blocks_split_a_hot_series(spark):
    from sparkassay.operators.ranks import to_blocks

    t = spark.range(40_000).select(F.when(F.col("id") % 4 < 3, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    largest = to_blocks(t, ["t"], ["k"], 8).groupBy("_block").count().agg(F.max("count")).first()[0]
    assert largest < 40_000 / 3
