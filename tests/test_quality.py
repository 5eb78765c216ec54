"""Quality metrics on hand-made tables."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.operators import quality as Q
from sparkassay.operators.ranks import order_statistics

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
NAN = float("nan")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, "a", 1.0, 1, None), (2, None, NAN, 2, None), (3, "b", None, None, None), (4, "a", -0.0, 4, None),
        (5, "", 0.0, 1, None),
    ]
    return spark.createDataFrame(rows, "id bigint, s string, x double, n int, nothing string")


def test_missing_is_null_or_nan(edge, value):
    assert value(Q.completeness_rate(edge, "x")) == 0.6
    assert value(Q.completeness_rate(edge, "s")) == 0.8
    assert value(Q.completeness_rate(edge, "nothing")) == 0.0
    assert value(Q.completeness_rate(edge, "absent")) == 0.0
    whole = value(Q.completeness_rate(edge))
    assert whole == pytest.approx(16 / 25)
    assert value(Q.total_missing_value_rate(edge)) == pytest.approx(1 - whole)


def test_empty_table(edge, value):
    empty = edge.where("id < 0")
    assert value(Q.completeness_rate(empty, "x")) is None
    assert value(Q.total_missing_value_rate(empty)) == 0.0
    assert value(Q.uniqueness_rate(empty, "s")) == 0.0
    assert value(Q.outlier_rate(empty, "x")) == 0.0
    assert value(Q.outlier_rate(empty, "x", "zscore")) == 0.0
    assert value(Q.format_validity_rate(empty, "s", "a")) == 0.0
    assert value(Q.exact_duplicate_overlap_rate(empty, edge)) == 0.0


def test_uniqueness(edge, value):
    assert value(Q.uniqueness_rate(edge, "s")) == 0.75
    assert value(Q.uniqueness_rate(edge, "x")) == pytest.approx(2 / 3)  # -0.0 is 0.0, NaN is missing
    assert value(Q.uniqueness_rate(edge, "nothing")) == 0.0
    assert value(Q.uniqueness_rate(edge, "absent")) == 0.0
    assert value(Q.uniqueness_rate(edge, "s", approx=True)) == 0.75


def test_long_texts_count_by_whole_text(spark, value):
    stem = "x" * 200
    texts = spark.createDataFrame([(stem + "a",), (stem + "b",), (stem + "a",), ("x",)], "t string")
    assert value(Q.uniqueness_rate(texts, "t")) == 0.75
    digest = texts.select(F.substring(V.key(texts, "t"), 2, 64)).first()[0]
    more = texts.unionAll(spark.createDataFrame([(digest,), ("#" + digest,)], "t string"))
    assert value(Q.uniqueness_rate(more, "t")) == pytest.approx(5 / 6)


def test_value_summary_keeps_types_apart(edge):
    rows = {r["column"]: r for r in Q.value_summary(edge, ["s", "x", "n", "nothing"]).collect()}
    assert (rows["n"]["present_rows"], rows["n"]["distinct_values"], rows["n"]["largest"]) == (4, 3, 2)
    assert (rows["x"]["distinct_values"], rows["x"]["smallest"]) == (2, 1)
    assert (rows["nothing"]["present_rows"], rows["nothing"]["largest"]) == (0, None)


def test_format_matches_at_the_start_only(spark, value):
    t = spark.createDataFrame([("ab1",), ("1ab",), ("abx",), (None,), ("b\nab",)], "t string")
    assert value(Q.format_validity_rate(t, "t", "ab")) == 0.5
    assert value(Q.format_validity_rate(t, "t", "x|a")) == 0.5
    assert value(Q.format_validity_rate(t, "t")) == 1.0
    assert value(Q.format_validity_rate(t.where("t IS NULL"), "t")) == 0.0


def test_coercion(spark):
    texts = ["1", " 2.5 ", "1d", "2F", "1e3", "abc", "", "NaN", "-inf", "Infinity", "0x10", "+.5", "1_0", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in t.select(V.number(t, "t")).collect()]
    assert got == [1.0, 2.5, None, None, 1000.0, None, None, None, -math.inf, math.inf, None, 0.5, None, None]


def test_schema_violations(edge, value):
    expected = {"s": "int", "x": float, "n": "str", "absent": "int", "id": bool, "nothing": "int"}
    assert value(Q.schema_type_violations(edge, expected)) == 1
    assert value(Q.schema_type_violations(edge, expected, strict=True)) == 2
    assert value(Q.schema_type_violations(edge, {"s": "date"}, strict=True)) == 1
    assert value(Q.schema_type_violations(edge, {})) == 0


def test_constant_column_has_no_outliers(spark, value):
    t = spark.range(50).select(F.lit(7.0).alias("v"))
    assert value(Q.outlier_rate(t, "v")) == 0.0
    assert value(Q.outlier_rate(t, "v", "zscore")) == 0.0


@few
@given(
    st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=120),
    st.sampled_from([100_000, 20]),
)
def test_quantiles_and_outliers_against_numpy(spark, xs, accuracy):
    t = spark.createDataFrame([(x,) for x in xs], "v double")
    a = np.array([x for x in xs if x is not None])
    stats = order_statistics(t, {"v": F.col("v")}, [0.25, 0.5, 0.75], accuracy=accuracy).collect()
    if len(a) == 0:
        assert stats == []
        return
    assert stats[0]["n"] == len(a)
    np.testing.assert_allclose(stats[0]["quantiles"], np.quantile(a, [0.25, 0.5, 0.75]), rtol=1e-12, atol=1e-9)
    q1, q3 = np.quantile(a, 0.25), np.quantile(a, 0.75)
    margin = 1e-9 * (1 + abs(q3 - q1))
    beyond = np.maximum(q1 - 1.5 * (q3 - q1) - a, a - q3 - 1.5 * (q3 - q1))
    if not np.any(np.abs(beyond) < margin):
        (got,) = Q.outlier_rates(t, ["v"], accuracy=accuracy).collect()
        assert got["value"] == pytest.approx(np.mean(beyond > 0))


def test_selection_in_many_rounds(spark):
    """Brackets of at most a few rows, sketches that are nearly useless, heavy values, infinite ends, many columns at once."""
    rng = np.random.default_rng(4)
    data = {
        "wide": np.exp(rng.normal(size=1500) * 30),
        "heavy": np.where(rng.random(1500) < 0.6, 1.0, np.where(rng.random(1500) < 0.5, 2.0, rng.normal(size=1500))),
        "ends": np.where(np.arange(1500) % 4 == 0, np.inf, np.where(np.arange(1500) % 4 == 1, -np.inf, rng.normal(size=1500))),
        "same": np.full(1500, -7.0),
    }
    t = spark.createDataFrame(pd.DataFrame(data)).repartition(6)
    fractions = [0.0, 0.001, 0.25, 0.3, 0.5, 0.75, 1.0]
    for accuracy, few in ((5000, 20_000), (250, 40)):
        got = {r["column"]: r for r in order_statistics(t, {c: F.col(c) for c in data}, fractions, accuracy=accuracy, few=few).collect()}
        for c, xs in data.items():
            ordered, places = np.sort(xs), [(len(xs) - 1) * f for f in fractions]
            for q, p in zip(got[c]["quantiles"], places, strict=True):
                a, b = ordered[math.floor(p)], ordered[math.ceil(p)]
                np.testing.assert_equal(q, float(a if a == b else a + (b - a) * (p - math.floor(p))), (c, p))
    assert order_statistics(t.limit(0), {"wide": F.col("wide")}, [0.5]).collect() == []


def test_quantiles_of_a_large_skewed_column(spark):
    # a third of the rows hold one value, the rest a long tail; a coarse sketch must not matter
    v = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.rand(3) * 100, F.lit(4)))
    t = spark.range(200_000, numPartitions=8).select(v.alias("v"))
    stored = t.toPandas()["v"]
    t = spark.createDataFrame(pd.DataFrame({"v": stored}))
    for accuracy in (100_000, 500):
        (row,) = order_statistics(t, {"v": F.col("v")}, [0.01, 0.25, 0.75, 0.99], accuracy=accuracy).collect()
        np.testing.assert_allclose(row["quantiles"], np.quantile(stored, [0.01, 0.25, 0.75, 0.99]), rtol=1e-12)


@pytest.fixture(scope="module")
def splits(spark):
    left = [(1, "x"), (1, "x"), (2, None), (3, "z"), (None, None)]
    right = [(1, "x"), (2, None), (2, None), (None, None), (9, "z")]
    return spark.createDataFrame(left, "a int, b string"), spark.createDataFrame(right, "a bigint, b string")


def test_duplicate_overlap(splits, value):
    left, right = splits
    # three distinct shared rows, missing matches missing, over all five rows
    assert value(Q.exact_duplicate_overlap_rate(left, right)) == 0.6
    assert value(Q.exact_duplicate_overlap_rate(left, left)) == 0.8
    assert value(Q.exact_duplicate_overlap_rate(left, right.withColumnRenamed("a", "c"))) == 0.6
    assert value(Q.exact_duplicate_overlap_rate(left, right.toDF("c", "d"))) == 0.0
    with pytest.raises(ValueError, match="without a common one"):
        Q.exact_duplicate_overlap_rate(left, right.select(F.col("a").cast("string").alias("a")))


def test_splits_with_unlike_columns_go_pair_by_pair(splits):
    left, right = splits
    rows = Q.exact_duplicate_overlap_rate_across_splits(left, right, left.select("b")).collect()
    got = {r["pair"]: r["value"] for r in rows}
    assert len(got) == 6
    assert got["train_test_overlap"] == 0.6 and got["test_train_overlap"] == 0.6
    assert got["val_train_overlap"] == 0.6  # x, missing and z of five rows


def test_wide_tables_go_some_columns_at_a_time(spark, monkeypatch):
    t = spark.range(100).select(*((F.col("id") * (i + 1)).alias(f"c{i}") for i in range(4)), F.pow("id", F.lit(6)).alias("c4"))
    whole = Q.outlier_rates(t, t.columns).collect()
    monkeypatch.setattr(Q, "SKETCHED_TOGETHER", 2)
    assert Q.outlier_rates(t, t.columns).collect() == whole
    assert [r["column"] for r in whole] == t.columns and whole[4]["value"] > 0 == whole[0]["value"]


def test_numbers_of_different_types_meet_exactly(spark, value):
    def one(v, kind):
        return spark.createDataFrame([(str(x),) for x in v], "a string").select(F.col("a").cast(kind).alias("a"))

    big = "9007199254740993"
    cases = [
        ([big], "bigint", ["9007199254740992"], "decimal(20,0)", 0.0), ([big], "bigint", [big], "decimal(20,2)", 1.0),
        ([big], "bigint", ["9007199254740992"], "double", 0.0), (["9007199254740992"], "bigint", ["9007199254740992"], "double", 1.0),
        (["0.10", "1e30", "-0.5"], "double", ["0.100", "5.000", "-0.50"], "decimal(10,3)", 2 / 3), (["0", "7"], "double", ["0", "7"], "int", 1.0),
        (["-0.0"], "double", ["0.00"], "decimal(38,2)", 1.0), (["12"], "decimal(38,0)", ["12.0"], "decimal(38,30)", 1.0),
        (["0.1"], "float", ["0.1"], "decimal(3,1)", 0.0), (["0.5"], "float", ["0.5"], "decimal(3,1)", 1.0), (["inf"], "double", ["5"], "int", 0.0),
    ]
    for left, k1, right, k2, expected in cases:
        assert value(Q.exact_duplicate_overlap_rate(one(left, k1), one(right, k2))) == pytest.approx(expected), (left, k1, right, k2)
        assert value(Q.exact_duplicate_overlap_rate(one(right, k2), one(left, k1))) == pytest.approx(expected), (left, k1, right, k2)
