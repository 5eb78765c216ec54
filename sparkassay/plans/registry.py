"""The metrics by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from sparkassay.operators import media, privacy, quality, series, stats

# What a metric is computed on: one column at a time, the table (or the listed columns of it
# together), the listed columns as positional arguments, or several tables.
COLUMN, TABLE, ARGUMENTS, TABLES = "column", "table", "arguments", "tables"


class Metric(NamedTuple):
    name: str
    category: str
    shape: str
    function: Callable[..., DataFrame]
    arity: int = 0


_METRICS = (
    Metric("completeness_rate", "data_quality", COLUMN, quality.completeness_rate),
    Metric("uniqueness_rate", "data_quality", COLUMN, quality.uniqueness_rate),
    Metric("format_validity_rate", "data_quality", COLUMN, quality.format_validity_rate),
    Metric("outlier_rate", "data_quality", COLUMN, quality.outlier_rate),
    Metric("total_missing_value_rate", "data_quality", TABLE, quality.total_missing_value_rate),
    Metric("schema_type_violations", "data_quality", TABLE, quality.schema_type_violations),
    Metric("exact_duplicate_overlap_rate", "data_quality", TABLES, quality.exact_duplicate_overlap_rate),
    Metric(
        "exact_duplicate_overlap_rate_across_splits",
        "data_quality",
        TABLES,
        quality.exact_duplicate_overlap_rate_across_splits,
    ),
    Metric("r_squared", "ml_statistical", ARGUMENTS, stats.r_squared, 2),
    Metric("variance_inflation_factor", "ml_statistical", COLUMN, stats.variance_inflation_factor),
    Metric("population_stability_index", "ml_statistical", ARGUMENTS, stats.population_stability_index, 2),
    Metric("change_point_detection_score", "ml_statistical", ARGUMENTS, series.change_point_detection_score, 2),
    Metric("class_imbalance_ratio", "fairness", COLUMN, stats.class_imbalance_ratio),
    Metric("demographic_parity_disparity", "fairness", ARGUMENTS, stats.demographic_parity_disparity, 2),
    Metric("target_leakage_count", "leakage", COLUMN, stats.target_leakage_count),
    Metric(
        "potential_target_leakage_candidate_count",
        "leakage",
        COLUMN,
        stats.potential_target_leakage_candidate_count,
    ),
    Metric("raw_pii_field_count", "leakage", TABLE, privacy.raw_pii_field_count),
    Metric("pii_contamination_rate", "privacy", TABLE, privacy.pii_contamination_rate),
    Metric("pii_phi_contamination_rate", "privacy", TABLE, privacy.pii_phi_contamination_rate),
    Metric("pii_phiviolation_rate", "privacy", TABLE, privacy.pii_phiviolation_rate),
    Metric("aspect_ratio_variance", "media", ARGUMENTS, media.aspect_ratio_variance, 2),
    Metric("blur_index", "media", COLUMN, media.blur_index),
    Metric("iou_intersection_over_union", "media", ARGUMENTS, media.intersection_over_union, 8),
)

METRICS: dict[str, Metric] = {m.name: m for m in _METRICS}

# Other names of the metrics. Display names need no entry of their own unless they
# differ by more than case and punctuation.
ALIASES = {
    "vif": "variance_inflation_factor",
    "iou": "iou_intersection_over_union",
    "intersection_over_union": "iou_intersection_over_union",
    "iou_intersection_over_union": "iou_intersection_over_union",
    "intersection_over_union_iou": "iou_intersection_over_union",
    "null_rate": "completeness_rate",
    "missing_values": "completeness_rate",
    "unique_count": "uniqueness_rate",
    "duplicates": "uniqueness_rate",
    "numerical_outlier_rate": "outlier_rate",
}

# Names listed beside the metrics' own.
DISPLAY_NAMES = (
    "vif",
    "iou",
    "intersection_over_union",
    "Variance Inflation Factor",
    "Population Stability Index",
    "Aspect Ratio Variance",
    "Blur Index",
    "IoU (Intersection over Union)",
    "Intersection Over Union (IoU)",
    "Schema Type Violations",
    "Change Point Detection Score",
)


def registry_key(name: str) -> str:
    """Lower case, runs of other characters as one underscore (as `functions.text.metric_key`)."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def names_to_metrics() -> dict[str, str]:
    """Every registry key, own or alias, with the metric it stands for."""
    return {name: name for name in METRICS} | ALIASES


def get_metric(name: str) -> Metric | None:
    """The metric of that name, ignoring case and punctuation."""
    found = names_to_metrics().get(registry_key(name))
    return METRICS[found] if found else None


def list_available_metrics() -> list[str]:
    return [*METRICS, *DISPLAY_NAMES]


def metric_categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for m in _METRICS:
        out.setdefault(m.category, []).append(m.name)
    return out


def compute(tables: dict[str, DataFrame], table: str, metric: str, *args: Any, **options: Any) -> DataFrame:
    """One metric over one table of a set, such as the tables of a session."""
    found = get_metric(metric)
    if found is None:
        raise ValueError(f"unknown metric {metric!r}")
    if table not in tables:
        raise ValueError(f"no table {table!r}")
    return found.function(tables[table], *args, **options)
