"""Regression, collinearity, drift, leakage, class balance and parity metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement
from typing import Any

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import values as V
from sparkassay.operators.quality import metric_row, ratio, total, value_summary

# A fit this close to exact counts as exact.
_EXACT = 1.0 - 1e-12
# Smallest eigenvalue of a correlation matrix that is inverted as a whole.
WELL_CONDITIONED = 1e-6
# Columns up to which every pair is an aggregate of its own.
WRITTEN_OUT = 8


def r_squared_of(df: DataFrame, actual: str, predicted: str) -> Column:
    y, p = V.number(df, actual), V.number(df, predicted)
    both = y.isNotNull() & p.isNotNull()
    spread = F.var_pop(F.when(both, y)) * F.count(F.when(both, y))
    error = F.sum(F.when(both, (y - p) * (y - p)))
    return F.when(spread != 0, 1 - F.try_divide(error, spread)).otherwise(F.lit(0.0))


def r_squared(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """1 - residual / total sum of squares (may be negative); 0 when the actual values are constant."""
    return metric_row(df, "r_squared", r_squared_of(df, actual, predicted))


# -- collinearity -------------------------------------------------------------------------------


def variance_inflation_factors(
    df: DataFrame, columns: Sequence[str] | None = None, others: Sequence[str] | None = None
) -> DataFrame:
    """Per column `(column, value)`: 1 / (1 - R²) of a least-squares fit on the other columns.

    The covariances of all columns are gathered over the complete rows; only that small matrix
    reaches the driver, where the fit is a pseudo-inverse. A row that is complete in the other
    columns but misses the column itself makes the fit fail, which counts as 1.
    """
    numeric = V.numeric_columns(df)
    columns = list(columns) if columns is not None else numeric
    spark = df.sparkSession
    fixed: dict[str, float] = {}
    groups: dict[tuple[str, ...], list[str]] = {}
    known = set(numeric)
    for c in columns:
        predictors = list(others) if others is not None else [n for n in numeric if n != c]
        if c not in df.columns:
            fixed[c] = 0.0
        elif not predictors or not known.issuperset((*predictors, c)):
            fixed[c] = 1.0
        else:
            groups.setdefault(tuple(sorted({*predictors, c})), []).append(c)
    for members, targets in groups.items():
        fixed |= _factors(df, list(members), targets, list(others) if others is not None else None)
    rows = [(c, fixed[c]) for c in columns]
    return spark.createDataFrame(rows, "column string, value double")


def _factors(df: DataFrame, members: list[str], targets: list[str], others: list[str] | None) -> dict[str, float]:
    moments = _covariances if len(members) <= WRITTEN_OUT else _correlations
    n, lost, cov = moments(df, {c: V.number(df, c) for c in members})
    if n < 2:
        return {t: 1.0 for t in targets}
    at_once = every_inflation(cov) if others is None else None
    out = {}
    for t in targets:
        y = members.index(t)
        if at_once is not None and not lost[y]:
            out[t] = float(at_once[y])
            continue
        # a row that is complete but for the target makes the fit fail
        chosen = others if others is not None else [c for c in members if c != t]
        out[t] = 1.0 if lost[y] else inflation(cov, y, [members.index(c) for c in chosen])
    return out


def _covariances(df: DataFrame, value: dict[str, Column]) -> tuple[int, list[int], np.ndarray]:
    """Complete rows, rows that miss one column only (by column) and covariances: every pair written out in one scan."""
    empty = total([v.isNull().cast("int") for v in value.values()])
    rows = df.select(empty.alias("_empty"), *(v.alias(f"v{i}") for i, v in enumerate(value.values())))
    k, complete = len(value), F.col("_empty") == 0
    kept = [F.when(complete, F.col(f"v{i}")) for i in range(k)]
    pairs = list(combinations_with_replacement(range(k), 2))
    row = rows.agg(
        F.count_if(complete).alias("n"),
        *(F.count_if((F.col("_empty") == 1) & F.col(f"v{i}").isNull()).alias(f"lost{i}") for i in range(k)),
        *(F.covar_pop(kept[i], kept[j]).alias(f"c{i}_{j}") for i, j in pairs),
    ).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], [row[f"lost{i}"] for i in range(k)], cov


def _correlations(df: DataFrame, value: dict[str, Column]) -> tuple[int, list[int], np.ndarray]:
    """The same for many columns, with correlations in place of covariances (zeros for a constant column).

    A row is one array here, so the query is no longer for 300 columns than for ten: one scan takes mean and spread of
    every column, and the complete rows, in units of these, are vectors whose outer products Spark adds up task by task."""
    row = F.array(*value.values())
    rows = df.select(row.alias("_row"), F.size(F.filter(row, lambda x: x.isNull())).alias("_empty"))
    here = F.when(F.col("_empty") == 0, F.col("x"))
    lost = F.count_if((F.col("_empty") == 1) & F.col("x").isNull())
    summary = (
        rows.select("_empty", F.posexplode("_row").alias("j", "x"))
        .groupBy("j")
        .agg(F.count(here).alias("n"), F.avg(here).alias("mean"), F.stddev_pop(here).alias("spread"), lost.alias("lost"))
    )
    of = {r["j"]: r for r in summary.collect()}  # a row per column
    k = len(value)
    n, lost_rows = (of[0]["n"], [of[j]["lost"] for j in range(k)]) if of else (0, [0] * k)
    varied = [j for j in range(k) if of and of[j]["spread"]]
    cov = np.zeros((k, k))
    if n >= 2 and varied:
        each = list(value.values())
        unit = F.array(*((each[j] - of[j]["mean"]) / of[j]["spread"] for j in varied))
        whole = F.forall(F.array(*each), lambda x: x.isNotNull())
        vectors = df.where(whole).select(array_to_vector(unit).alias("unit"))
        cov[np.ix_(varied, varied)] = Correlation.corr(vectors, "unit").first()[0].toArray()
    return n, lost_rows, cov


def every_inflation(cov: np.ndarray) -> np.ndarray | None:
    """1 / (1 - R²) of each variable on all others: the diagonal of the inverse correlations. None where these are so close
    to singular that each fit has to be looked at by itself."""
    scale = np.sqrt(np.diag(cov))
    varied = np.flatnonzero(scale > 0)
    corr = cov[np.ix_(varied, varied)] / np.outer(scale[varied], scale[varied])
    if len(varied) < 2 or np.linalg.eigvalsh(corr)[0] < WELL_CONDITIONED:
        return None
    out = np.full(len(cov), math.inf)
    out[varied] = np.maximum(np.diag(np.linalg.inv(corr)), 1.0)
    return out


def inflation(cov: np.ndarray, y: int, xs: list[int]) -> float:
    """1 / (1 - R²) of variable y on the variables xs, from their covariance matrix."""
    scale = np.sqrt(np.diag(cov))
    xs = [x for x in xs if scale[x] > 0]
    if scale[y] == 0:
        return math.inf
    if not xs:
        return 1.0
    corr = cov[np.ix_(xs, xs)] / np.outer(scale[xs], scale[xs])
    to_y = cov[xs, y] / (scale[xs] * scale[y])
    fit = float(to_y @ np.linalg.pinv(corr, rcond=1e-12, hermitian=True) @ to_y)
    return math.inf if fit >= _EXACT else 1.0 / (1.0 - max(fit, 0.0))


def variance_inflation_factor(df: DataFrame, column: str, others: Sequence[str] | None = None) -> DataFrame:
    return variance_inflation_factors(df, [column], others).select(
        F.lit("variance_inflation_factor").alias("metric"), "value"
    )


# -- drift --------------------------------------------------------------------------------------


def population_stability_index(
    expected: DataFrame, expected_column: str, actual: DataFrame, actual_column: str, bins: int = 10
) -> DataFrame:
    """Drift between two columns over equal-width bins of their joint range; 0 if a side is empty.

    The range is one scalar; the bin of a value is found by division and then corrected against
    the bin's own edges, so that a value on an edge falls where the edges say. What is shuffled is
    one count per bin, side and task.
    """
    sides = expected.select(V.number(expected, expected_column).alias("v"), F.lit(0).alias("side")).unionAll(
        actual.select(V.number(actual, actual_column).alias("v"), F.lit(1).alias("side"))
    )
    sides = sides.where("v IS NOT NULL")
    span = sides.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("span")).scalar()
    low, high, v = span["low"], span["high"], F.col("v")
    step = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, high).otherwise(low + i * step)

    guess = F.least(
        F.lit(bins - 1),
        F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(v - low, step)), F.lit(bins - 1)).cast("int")),
    )
    placed = sides.select("side", "v", guess.alias("g"))
    g = F.col("g")
    fixed = (
        F.when((v < edge(g)) & (g > 0), g - 1).when((v >= edge(g + 1)) & (g < bins - 1), g + 1).otherwise(g)
    )
    counts = placed.groupBy(fixed.alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a")
    )
    # at most `bins` rows from here on
    smoothed = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("e", "a")))).alias("by_bin"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("e_rows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("a_rows"),
    )
    tiny, everywhere = 1e-10, bins * 1e-10

    def term(i: Column) -> Column:
        cell = F.try_element_at(F.col("by_bin"), i)
        e = (F.coalesce(cell["e"], F.lit(0)) + tiny) / (F.col("e_rows") + everywhere)
        a = (F.coalesce(cell["a"], F.lit(0)) + tiny) / (F.col("a_rows") + everywhere)
        return (a - e) * F.log(a / e)

    index = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), term), F.lit(0.0), lambda acc, x: acc + x
    )
    value = F.when((F.col("e_rows") == 0) | (F.col("a_rows") == 0), F.lit(0.0)).otherwise(index)
    return smoothed.select(F.lit("population_stability_index").alias("metric"), value.alias("value"))


# -- leakage ------------------------------------------------------------------------------------


def leakage_of(
    df: DataFrame, target: str, features: Sequence[str] | None = None, threshold: float = 0.95
) -> Column:
    if target not in df.columns:
        return F.lit(0)
    if features is None:
        features = [c for c in V.numeric_columns(df) if c != target]
    flags = [F.lit(0)]
    for f in features:
        if f not in df.columns:
            continue
        t, x = V.number(df, target), V.number(df, f)
        both = t.isNotNull() & x.isNotNull()
        t, x = F.when(both, t), F.when(both, x)
        r = F.try_divide(F.covar_pop(t, x), F.stddev_pop(t) * F.stddev_pop(x))
        flags.append(F.when((F.count(t) > 2) & (F.abs(r) >= threshold), F.lit(1)).otherwise(F.lit(0)))
    return total(flags)


def target_leakage_count(
    df: DataFrame, target: str, features: Sequence[str] | None = None, threshold: float = 0.95
) -> DataFrame:
    """Features whose absolute correlation with the target reaches the threshold; one scan."""
    return metric_row(df, "target_leakage_count", leakage_of(df, target, features, threshold))


def potential_target_leakage_candidate_count(df: DataFrame, target: str) -> DataFrame:
    return metric_row(df, "potential_target_leakage_candidate_count", leakage_of(df, target))


# -- balance and parity -------------------------------------------------------------------------


def imbalance_from(summary: DataFrame) -> Column:
    return F.when(summary["distinct_values"] < 2, F.lit(1.0)).otherwise(
        ratio(summary["largest"], summary["smallest"])
    )


def class_imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Rows of the largest class / rows of the smallest; 1 with fewer than two classes."""
    name = "class_imbalance_ratio"
    if target not in df.columns:
        return metric_row(df, name, F.lit(0.0))
    summary = value_summary(df, [target])
    return metric_row(summary, name, F.coalesce(F.max(imbalance_from(summary)), F.lit(1.0)))


def _is_label(df: DataFrame, outcome: str, label: Any) -> Column:
    kind = V.data_type(df, outcome)
    if isinstance(label, str):
        same = V.col(outcome) == label if isinstance(kind, T.StringType) else F.lit(False)
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        same = V.col(outcome).cast("double") == float(label)
    else:
        same = F.lit(False)
    return F.coalesce(same, F.lit(False))


def demographic_parity_disparity(
    df: DataFrame, protected: str, outcome: str, positive_label: Any = 1
) -> DataFrame:
    """Largest minus smallest share of positive outcomes among the groups of the protected column;
    a missing outcome is not positive, rows of no group are left out; 0 with fewer than two."""
    name = "demographic_parity_disparity"
    if protected not in df.columns or outcome not in df.columns:
        return metric_row(df, name, F.lit(0.0))
    rates = (
        df.where(V.present(df, protected))
        .groupBy(V.key(df, protected).alias("grp"))
        .agg(F.avg(_is_label(df, outcome, positive_label).cast("double")).alias("rate"))
    )
    gap = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.max("rate") - F.min("rate"))
    return metric_row(rates, name, gap)
