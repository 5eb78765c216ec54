"""Physical plans: no Python in the rows, no cross joins, pruned scans, reused work."""

import pytest
from pyspark.sql import functions as F

from sparkassay import workload
from sparkassay.operators import quality

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_no_cross_join_and_no_python(spark, folder, name):
    plan = physical(workload.QUERIES[name](spark, folder))
    assert not [word for word in FORBIDDEN if word in plan]


def test_scans_read_only_their_columns(spark, folder):
    plan = physical(workload.QUERIES["outlier_rate_iqr"](spark, folder))
    assert "ReadSchema: struct<value:double>" in plan and "props" not in plan


def test_filters_reach_the_scan(spark, folder):
    plan = physical(workload.QUERIES["scan_parquet"](spark, folder).where("o_totalprice > 400000").select("o_orderkey"))
    assert "GreaterThan(o_totalprice,400000" in plan


def test_equal_rows_are_counted_before_the_shuffle(spark):
    hot = spark.range(100_000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("t"))
    plan = physical(quality.rows_by_table([hot, hot], ["t"]))
    assert plan.index("Exchange") < plan.index("partial_sum")  # the plan is printed top down
