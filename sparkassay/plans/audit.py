"""Run an evaluation plan over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkassay.functions import patterns as P
from sparkassay.functions import values as V
from sparkassay.operators import media, privacy, quality, series, stats
from sparkassay.operators.ranks import written
from sparkassay.plans.plan import plan_table, resolve_plan

# Aggregates computed together in one scan of a table.
FUSED = 40

RESULT_COLUMNS = (
    "table", "column", "requested_metric", "executed_metric", "value", "status", "error_message",
)


def audit(
    tables: Mapping[str, DataFrame], plan: DataFrame | Iterable[Any], settle: Iterable[str] = ()
) -> DataFrame:
    """Results of a plan as rows `(table, column, requested_metric, executed_metric, value, status,
    error_message)`.

    Only the resolved plan (one row per table, column and metric) comes to the driver, to build
    the query from. Per table, all metrics that need one scan share one aggregation; uniqueness and
    class balance of all columns share one counting shuffle, outlier rates of all columns one set
    of scans, inflation factors one covariance scan.

    Tables named in `settle` are written to the shared folder first: a table that is itself a
    costly query is then evaluated once, not once per scan.
    """
    settled = set(settle)
    tables = {name: written(df, "audited") if name in settled else df for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    if not isinstance(plan, DataFrame):
        plan = plan_table(spark, plan)
    resolved = resolve_plan(plan, tables).orderBy("plan_no", "table", "column").collect()
    labels = []
    runnable: dict[str, list[tuple[int, Row, str]]] = {}
    for row in resolved:
        error = row["error_message"] or _problem(tables, row)
        # one result row each, but one per pair of splits where a metric answers several
        for column in _pairs(row) if error is None and row["executed_metric"] == _SPLITS else [row["column"]]:
            empty = _WITHOUT_ROWS.get(row["executed_metric"])
            labels.append(
                (len(labels), row["table"], column, row["requested_metric"], row["executed_metric"], error, empty)
            )
            if error is None:
                runnable.setdefault(row["table"], []).append((len(labels) - 1, row, column))
    parts = [spark.createDataFrame([], "no int, value double")]
    for table, rows in runnable.items():
        parts += _run(tables, tables[table], rows)
    results = functools.reduce(DataFrame.unionAll, parts)
    named = spark.createDataFrame(
        labels,
        "no int, table string, column string, requested_metric string, executed_metric string, "
        "error_message string, empty double",
    )
    status = F.when(F.col("error_message").isNull(), "success").otherwise("error")
    value = F.coalesce("value", F.when(F.col("error_message").isNull(), F.col("empty")))
    return (
        named.join(results, "no", "left")
        .withColumn("status", status)
        .withColumn("value", value)
        .select(*RESULT_COLUMNS)
    )


_SPLITS = "exact_duplicate_overlap_rate_across_splits"

# Metrics whose query has no row for a table without rows, with their value there.
_WITHOUT_ROWS = {"uniqueness_rate": 0.0, "class_imbalance_ratio": 1.0}


def _pairs(row: Row) -> list[str]:
    names = ["train_test", "test_train"]
    if "val" in (row["params"] or {}):
        names += ["val_train", "train_val", "val_test", "test_val"]
    return [f"{n}_overlap" for n in names]


def _problem(tables: Mapping[str, DataFrame], row: Row) -> str | None:
    """Why a resolved row cannot run, None if it can."""
    metric, params = row["executed_metric"], row["params"] or {}
    df = tables[row["table"]]
    missing = [c for c in row["columns"] or () if c not in df.columns]
    if missing:
        return f"table '{row['table']}' has no column '{missing[0]}'"
    if metric in ("exact_duplicate_overlap_rate", _SPLITS):
        needed = ["other"] if metric == "exact_duplicate_overlap_rate" else ["train", "test"]
        for name in needed:
            if params.get(name) not in tables:
                return f"parameter '{name}' must name a table"
    if metric == _SPLITS and params.get("val", params["train"]) not in tables:
        return "parameter 'val' must name a table"
    if metric == "blur_index" and (not row["columns"] or "width" not in params):
        return "needs a pixel column and the parameter 'width'"
    if row["columns"] is None and metric in _NEEDS_COLUMN:
        return "needs a column"
    return None


_NEEDS_COLUMN = (
    "uniqueness_rate",
    "format_validity_rate",
    "outlier_rate",
    "class_imbalance_ratio",
    "target_leakage_count",
    "potential_target_leakage_candidate_count",
    "variance_inflation_factor",
)


def _part(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The listed columns of a table, all if none are listed."""
    return df.select(*(V.col(c) for c in columns if c in df.columns)) if columns else df


def _listed(text: str | None) -> list[str] | None:
    return [t.strip() for t in text.split(",")] if text else None


def _fused(df: DataFrame, row: Row) -> Column | None:
    """The aggregate of a metric that needs one scan only."""
    metric, columns, params = row["executed_metric"], row["columns"], row["params"] or {}
    first = columns[0] if columns else None
    # what a whole-table metric is asked for on some columns concerns these only
    listed = _part(df, columns)
    match metric:
        case "completeness_rate":
            return quality.completeness_of(df, first)
        case "total_missing_value_rate":
            return quality.missing_of(listed)
        case "format_validity_rate":
            return quality.format_validity_of(df, first, params.get("pattern"))
        case "schema_type_violations":
            reserved = {"strict"}
            expected = {c: t for c, t in params.items() if c not in reserved and (not columns or c in columns)}
            return quality.schema_violations_of(df, expected, params.get("strict", "").lower() == "true")
        case "r_squared":
            return stats.r_squared_of(df, *columns)
        case "target_leakage_count" | "potential_target_leakage_candidate_count":
            return stats.leakage_of(
                df, first, _listed(params.get("features")), float(params.get("threshold", 0.95))
            )
        case "pii_contamination_rate":
            return privacy.contamination_of(df, P.PII_PATTERNS, columns)
        case "pii_phi_contamination_rate":
            return privacy.contamination_of(df, P.PHI_PATTERNS, columns)
        case "pii_phiviolation_rate":
            return privacy.violation_of(df, columns)
        case "raw_pii_field_count":
            return F.lit(len(privacy.raw_pii_fields(listed)))
        case "aspect_ratio_variance":
            return media.aspect_ratio_of(df, *columns)
        case "iou_intersection_over_union":
            # over a table of box pairs: their mean
            return F.avg(media.B.iou([V.col(c) for c in columns[:4]], [V.col(c) for c in columns[4:]]))
        case "blur_index":
            # over a table of images: their mean
            return F.avg(media.B.sharpness(V.col(first), int(params["width"])))
    return None


def _run(tables: Mapping[str, DataFrame], df: DataFrame, rows: list[tuple[int, Row, str]]) -> list[DataFrame]:
    """DataFrames `(no, value)` that together answer the rows of one table."""
    fused: list[tuple[int, Column]] = []
    summarised: list[tuple[int, str, str]] = []
    outliers: dict[str, list[tuple[int, str]]] = {}
    inflated: dict[str | None, list[tuple[int, str]]] = {}
    parts: list[DataFrame] = []
    splits: dict[tuple[str, str, str | None, tuple[str, ...]], list[tuple[int, str]]] = {}
    for no, row, column in rows:
        metric, columns, params = row["executed_metric"], row["columns"], row["params"] or {}
        one_scan = _fused(df, row)
        if one_scan is not None:
            fused.append((no, one_scan))
        elif metric in ("uniqueness_rate", "class_imbalance_ratio"):
            summarised.append((no, columns[0], metric))
        elif metric == "outlier_rate":
            outliers.setdefault(params.get("method", "iqr"), []).append((no, columns[0]))
        elif metric == "variance_inflation_factor":
            inflated.setdefault(params.get("others"), []).append((no, columns[0]))
        elif metric == _SPLITS:
            splits.setdefault((params["train"], params["test"], params.get("val"), tuple(columns or ())), []).append((no, column))
        else:
            parts.append(_alone(tables, df, metric, columns, params).select(F.lit(no).alias("no"), "value"))
    for start in range(0, len(fused), FUSED):
        cells = [
            F.struct(F.lit(no).alias("no"), value.cast("double").alias("value"))
            for no, value in fused[start : start + FUSED]
        ]
        parts.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    if summarised:
        parts.append(_from_summary(df, summarised))
    for method, wanted in outliers.items():
        rates = quality.outlier_rates(df, sorted({c for _, c in wanted}), method)
        parts.append(_numbered(rates, wanted))
    for (train, test, val, columns), wanted in splits.items():
        parts_of = [_part(tables[n], columns) if n else None for n in (train, test, val)]
        rates = quality.exact_duplicate_overlap_rate_across_splits(*parts_of)
        parts.append(_numbered(rates.withColumnRenamed("pair", "column"), wanted))
    for others, wanted in inflated.items():
        factors = stats.variance_inflation_factors(df, sorted({c for _, c in wanted}), _listed(others))
        parts.append(_numbered(factors, wanted))
    return parts


def _numbered(by_column: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """`(column, value)` rows as `(no, value)`."""
    numbers: dict[str, list[int]] = {}
    for no, c in wanted:
        numbers.setdefault(c, []).append(no)
    entries = [x for c, nos in numbers.items() for x in (F.lit(c), F.array(*map(F.lit, nos)))]
    return by_column.select(F.explode(F.create_map(*entries)[F.col("column")]).alias("no"), "value")


def _from_summary(df: DataFrame, wanted: list[tuple[int, str, str]]) -> DataFrame:
    summary = quality.value_summary(df, sorted({c for _, c, _ in wanted}))
    values = {"uniqueness_rate": quality.uniqueness_from(summary), "class_imbalance_ratio": stats.imbalance_from(summary)}
    cells = [
        F.struct(F.lit(c).alias("of"), F.lit(no).alias("no"), values[metric].alias("value")) for no, c, metric in wanted
    ]
    every = summary.select("column", F.inline(F.array(*cells)))
    # a table without rows has no summary: the result row then keeps its label without a value
    return every.where("column = of").select("no", "value")


def _alone(
    tables: Mapping[str, DataFrame], df: DataFrame, metric: str, columns: list[str] | None, params: Mapping[str, str]
) -> DataFrame:
    """A metric with a query of its own."""
    match metric:
        case "population_stability_index":
            return stats.population_stability_index(df, columns[0], df, columns[1], int(params.get("bins", 10)))
        case "demographic_parity_disparity":
            label: Any = params.get("positive_label", 1)
            if isinstance(label, str) and label.lstrip("-").replace(".", "", 1).isdigit():
                label = float(label)
            return stats.demographic_parity_disparity(df, columns[0], columns[1], label)
        case "change_point_detection_score":
            return series.change_point_detection_score(df, columns[0], columns[1])
        case "exact_duplicate_overlap_rate":
            return quality.exact_duplicate_overlap_rate(_part(df, columns), tables[params["other"]])
    raise ValueError(f"no way to run {metric!r}")


def summarize(report: DataFrame) -> DataFrame:
    """One row `(total_metrics_evaluated, successful_evaluations, failed_evaluations, plan_score,
    plan_status)`; a report without results scores 0 and is REJECTED."""
    total = F.count("*")
    return report.agg(
        total.alias("total_metrics_evaluated"),
        F.count_if(F.col("status") == "success").alias("successful_evaluations"),
        F.count_if(F.col("status") != "success").alias("failed_evaluations"),
        F.when(total == 0, F.lit(0)).alias("plan_score"),
        F.when(total == 0, F.lit("REJECTED")).alias("plan_status"),
    )
