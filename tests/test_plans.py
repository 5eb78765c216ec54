"""Plan resolution, the registry and audits on hand-made tables."""

import math

import pytest

from sparkassay import audit, compute, get_metric, list_available_metrics, summarize
from sparkassay.plans.plan import plan_by_column, plan_table, resolve_plan
from sparkassay.plans.registry import ALIASES, METRICS, metric_categories, registry_key


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame(
        [(1, "jo", 3.0, 1), (2, None, 4.0, 0), (3, "al", float("nan"), 1), (4, "jo", 5.0, None)],
        "id int, name string, score double, label int",
    )
    pets = spark.createDataFrame([("rex", 1), ("tom", 2)], "name string, owner int")
    return {"people": people, "pets": pets}


def test_registry_names():
    assert len(list_available_metrics()) == 34
    assert all(get_metric(n) for n in list_available_metrics())
    assert get_metric("IoU (Intersection over Union)").name == "iou_intersection_over_union"
    assert get_metric(" Class-Imbalance RATIO ").name == "class_imbalance_ratio"
    assert get_metric("missing_values").name == "completeness_rate"
    assert get_metric("entropy") is None
    assert set(metric_categories()) == {"data_quality", "ml_statistical", "fairness", "leakage", "privacy", "media"}
    assert all(registry_key(a) == a and m in METRICS for a, m in ALIASES.items())


def test_compute(tables, value):
    assert value(compute(tables, "people", "null rate", "name")) == 0.75
    assert value(compute(tables, "people", "outlier_rate", "score", method="zscore")) == 0.0
    with pytest.raises(ValueError, match="unknown metric"):
        compute(tables, "people", "entropy")
    with pytest.raises(ValueError, match="no table"):
        compute(tables, "plants", "completeness_rate")


def test_plan_by_column(spark):
    plan = plan_table(
        spark,
        [
            [{"metric_name": "a", "target_columns": ["x", "y"], "reasoning": "first"}],
            [{"metric_name": "a", "target_columns": ["x"], "reasoning": "again"}, {"metric_name": None, "target_columns": ["x"]}],
            None,
            {"metric_name": "b", "target_columns": None},
            {"metric_name": "b", "target_columns": []},
        ],
    )
    assert {tuple(r) for r in plan_by_column(plan).collect()} == {("x", "a", "first"), ("y", "a", "first")}
    assert [r["source"] for r in plan.orderBy("plan_no").collect()][:3] == ["group 0", "group 1", "group 1"]


def test_resolution(spark, tables):
    plan = plan_table(
        spark,
        [
            {"metric_name": "Null Rate", "target_columns": ["name", "owner"]},
            {"metric_name": "completeness_rate", "target_columns": ["all"]},
            {"metric_name": "completeness_rate", "target_columns": None},
            {"metric_name": "r_squared", "target_columns": ["score", "label"]},
        ],
    )
    rows = {(r["table"], r["column"], r["executed_metric"]): r["requested_metric"] for r in resolve_plan(plan, tables).collect()}
    # a column belongs to the first table that holds it, and each pair is kept once
    assert rows[("people", "name", "completeness_rate")] == "Null Rate"
    assert rows[("pets", "owner", "completeness_rate")] == "Null Rate"
    assert rows[("pets", "name", "completeness_rate")] == "completeness_rate"
    assert rows[("people", "all", "completeness_rate")] == "completeness_rate"
    assert rows[("people", "score,label", "r_squared")] == "r_squared"
    assert len(rows) == 6 + 2 + 1


def test_audit(tables):
    plan = [
        {"metric_name": "completeness_rate", "target_columns": ["name"]},
        {"metric_name": "completeness_rate", "target_columns": None},
        {"metric_name": "uniqueness_rate", "target_columns": ["name"]},
        {"metric_name": "class_imbalance_ratio", "target_columns": ["label"]},
        {"metric_name": "schema_type_violations", "target_columns": None, "params": {"name": "int", "strict": "true"}},
        {"metric_name": "vif", "target_columns": ["score"], "params": {"others": "id"}},
        {"metric_name": "uniqueness_rate", "target_columns": None},
        {"metric_name": "population_stability_index", "target_columns": ["id", "score"], "params": {"bins": "1"}},
        {"metric_name": "blur_index", "target_columns": ["score"]},
        {"metric_name": "magic", "target_columns": ["name"]},
        {"metric_name": "r_squared", "target_columns": ["owner", "id"]},
    ]
    report = audit(tables, plan)
    rows = {(r["table"], r["column"], r["requested_metric"]): r for r in report.collect()}
    assert rows[("people", "name", "completeness_rate")]["value"] == 0.75
    assert rows[("people", "all", "completeness_rate")]["value"] == pytest.approx(13 / 16)
    assert rows[("pets", "all", "completeness_rate")]["value"] == 1.0
    assert rows[("people", "name", "uniqueness_rate")]["value"] == pytest.approx(2 / 3)
    assert rows[("people", "label", "class_imbalance_ratio")]["value"] == 2.0
    assert rows[("people", "all", "schema_type_violations")]["value"] == 1.0
    assert rows[("people", "score", "vif")]["value"] == 1.0
    assert rows[("people", "all", "uniqueness_rate")]["error_message"] == "needs a column"
    assert rows[("people", "id,score", "population_stability_index")]["value"] == pytest.approx(0.0)
    assert "width" in rows[("people", "score", "blur_index")]["error_message"]
    assert rows[(None, "name", "magic")]["status"] == "error"
    assert "no column 'id'" in rows[("pets", "owner,id", "r_squared")]["error_message"]
    assert all((r["error_message"] is None) == (r["status"] == "success") for r in rows.values())
    total, good, bad, score, status = summarize(report).first()
    assert (total, bad) == (len(rows), 5) and good + bad == total and score is None and status is None


def test_audit_of_a_table_without_rows(tables):
    empty = {"people": tables["people"].limit(0)}
    plan = [{"metric_name": m, "target_columns": ["label"]} for m in ("uniqueness_rate", "class_imbalance_ratio", "outlier_rate", "vif")]
    rows = {r["requested_metric"]: r["value"] for r in audit(empty, plan).collect()}
    assert rows == {"uniqueness_rate": 0.0, "class_imbalance_ratio": 1.0, "outlier_rate": 0.0, "vif": 1.0}


def test_empty_plan_is_rejected(tables):
    row = summarize(audit(tables, [])).first()
    assert (row["total_metrics_evaluated"], row["plan_score"], row["plan_status"]) == (0, 0, "REJECTED")


def test_many_metrics_are_cut_into_several_scans(tables):
    plan = [
        {"metric_name": "format_validity_rate", "target_columns": ["name"], "params": {"pattern": "j"}},
        *({"metric_name": "completeness_rate", "target_columns": [c]} for c in ("id", "name", "score", "label", "owner")),
    ]
    import sparkassay.plans.audit as module

    before, module.FUSED = module.FUSED, 2
    try:
        values = [r["value"] for r in audit(tables, plan).collect()]
    finally:
        module.FUSED = before
    assert len(values) == 6 and not any(v is None or math.isnan(v) for v in values)


def test_audit_of_every_column_type(spark):
    t = spark.sql(
        """SELECT id, CAST(id AS DECIMAL(10,2)) AS dec, DATE'2024-01-01' + CAST(id AS INT) AS day,
                  TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts,
                  TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ntz,
                  id % 2 = 0 AS flag, CAST(CAST(id AS STRING) AS BINARY) AS raw, array(id, id + 1) AS list,
                  map('k', id) AS pairs, named_struct('a', id, 'b', 'x') AS nested, CAST(id AS FLOAT) AS real,
                  CAST(NULL AS STRING) AS nothing FROM range(40)"""
    )
    names = (
        "completeness_rate", "uniqueness_rate", "outlier_rate", "format_validity_rate", "class_imbalance_ratio",
        "potential_target_leakage_candidate_count", "vif",
    )
    plan = [{"metric_name": m, "target_columns": ["all"]} for m in names]
    plan += [{"metric_name": m, "target_columns": None} for m in ("pii_contamination_rate", "total_missing_value_rate")]
    rows = {(r["column"], r["requested_metric"]): r for r in audit({"t": t}, plan, settle=["t"]).collect()}
    assert len(rows) == len(names) * len(t.columns) + 2
    assert all(r["status"] == "success" and r["value"] is not None for r in rows.values())
    for c in t.columns:
        distinct = {"flag": 2 / 40, "nothing": 0.0}.get(c, 1.0)
        assert rows[(c, "uniqueness_rate")]["value"] == pytest.approx(distinct), c
    assert rows[("flag", "class_imbalance_ratio")]["value"] == 1.0
    assert rows[("id", "vif")]["value"] == math.inf
    # id, dec and real move together; the target itself is left out
    assert rows[("id", "potential_target_leakage_candidate_count")]["value"] == 2
    assert rows[("day", "potential_target_leakage_candidate_count")]["value"] == 3
    assert rows[("ts", "outlier_rate")]["value"] == 0.0


def test_search_counts_paths_and_a_hot_source(spark):
    from sparkassay.operators.knowledge import search_metrics

    fields = "id long, label string, name string, formula string, threshold_pass double, threshold_warn double, threshold_fail double"
    nodes = [(1, "MODALITY", "m"), (2, "TASK", "t"), (3, "TASK", "t"), (4, "DOMAIN", "d"), (5, "DOMAIN", "other")]
    nodes += [(100 + i, "METRICS", f"x{i}") for i in range(500)]
    edges = [(1, "TYPE", 2), (1, "TYPE", 3), (2, "WITH", 4), (3, "WITH", 4), (2, "WITH", 5)]
    edges += [(4, "GOT", 100 + i) for i in range(400)] + [(5, "GOT", 100 + i) for i in range(400, 500)] + [(4, "GOT", 101)]
    n = spark.createDataFrame([(*x, "f", 1.0, 2.0, 3.0) for x in nodes], fields)
    e = spark.createDataFrame(edges, "src long, type string, dst long")
    found = search_metrics(n, e, "D", "M", "T")
    counts = {r["name"]: r["count"] for r in found.groupBy("name").count().collect()}
    assert len(counts) == 400 and counts["x0"] == 2 and counts["x1"] == 4  # two tasks lead there, one edge stands twice
    assert search_metrics(n, e, "d", "nothing", "t").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan and "hashpartitioning(dst" in plan or "BroadcastHashJoin [dst" in plan
