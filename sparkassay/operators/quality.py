"""Completeness, uniqueness, format, outliers, schema and duplicate metrics.

Functions named after a metric answer a one-row DataFrame `(metric, value)`. Functions ending in
`_of` give the aggregate expression alone, so that an audit can compute many of them in one scan.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import values as V
from sparkassay.operators.ranks import SKETCH_ACCURACY, SKETCH_GROUPS, order_statistics


# Columns whose quantiles are sketched in one scan.
SKETCHED_TOGETHER = 16


def metric_row(df: DataFrame, metric: str, aggregate: Column) -> DataFrame:
    return df.agg(aggregate.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "value")


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, or `empty` where the whole is zero."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return share if empty is None else F.coalesce(share, F.lit(empty))


def total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


# -- single-scan aggregates ---------------------------------------------------------------------


def completeness_of(df: DataFrame, column: str | None = None) -> Column:
    if column is None:
        cells = total([F.count_if(V.present(df, c)) for c in df.columns])
        return ratio(cells, F.count("*") * len(df.columns), empty=None)
    if column not in df.columns:
        return F.lit(0.0)
    return ratio(F.count_if(V.present(df, column)), F.count("*"), empty=None)


def missing_of(df: DataFrame) -> Column:
    if not df.columns:
        return F.lit(0.0)
    cells = total([F.count_if(~V.present(df, c)) for c in df.columns])
    return ratio(cells, F.count("*") * len(df.columns))


def format_validity_of(df: DataFrame, column: str, pattern: str | None = None) -> Column:
    if column not in df.columns:
        return F.lit(0.0)
    cells = F.count_if(V.present(df, column))
    if not pattern:
        return F.when(cells > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    # a match must begin at the start of the text but may end anywhere
    return ratio(F.count_if(V.text(df, column).rlike(r"(?U)\A(?:" + pattern + ")")), cells)


def schema_violations_of(df: DataFrame, expected: Mapping[str, str | type], strict: bool = False) -> Column:
    """Number of expected columns that are absent; with `strict` also those holding a cell that
    is not of the expected type."""
    parts = [F.lit(1) for c in expected if c not in df.columns]
    if strict:
        for name, kind in expected.items():
            if name in df.columns:
                bad = V.present(df, name) & ~_fits(df, name, kind)
                parts.append(F.coalesce(F.max(bad.cast("int")), F.lit(0)))
    return total([F.lit(0), *parts])


def _fits(df: DataFrame, name: str, kind: str | type) -> Column:
    kind = kind.__name__ if isinstance(kind, type) else kind.lower()
    if kind in ("str", "string"):
        return F.lit(True)
    numeric = V.number(df, name).isNotNull()
    if kind in ("int", "float"):
        return numeric
    if kind == "bool":
        if isinstance(V.data_type(df, name), T.StringType):
            return numeric | V.col(name).try_cast("boolean").isNotNull()
        return numeric
    return V.col(name).cast("string").try_cast(kind).isNotNull()


def completeness_rate(df: DataFrame, column: str | None = None) -> DataFrame:
    """Present cells over rows, or over all cells; NULL for a table without rows."""
    return metric_row(df, "completeness_rate", completeness_of(df, column))


def total_missing_value_rate(df: DataFrame) -> DataFrame:
    """Missing cells over all cells; 0 when there are no cells."""
    return metric_row(df, "total_missing_value_rate", missing_of(df))


def format_validity_rate(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Share of the present values whose text begins with a match of the pattern."""
    return metric_row(df, "format_validity_rate", format_validity_of(df, column, pattern))


def schema_type_violations(df: DataFrame, expected: Mapping[str, str | type], strict: bool = False) -> DataFrame:
    return metric_row(df, "schema_type_violations", schema_violations_of(df, expected, strict))


# -- distinct values ----------------------------------------------------------------------------


def value_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column `(column, present_rows, distinct_values, largest, smallest)`, where the last two
    are the row counts of the most and least frequent value.

    All columns share one shuffle: cells become (column number, key) rows, which are counted
    before they are shuffled, so a value that fills the table travels once per task.
    """
    lanes = [V.key_lane(df, c) for c in columns]
    used = [lane for lane in ("long", "double", "string") if any(kind == lane for kind, _ in lanes)]
    cells = []
    for i, (kind, key) in enumerate(lanes):
        slots = [(key if kind == lane else F.lit(None).cast(_LANE_TYPE[lane])).alias(lane) for lane in used]
        cells.append(F.struct(F.lit(i).alias("i"), key.isNotNull().alias("present"), *slots))
    counts = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("i", "present", *used)
        .agg(F.count("*").alias("rows"))
    )
    here = F.when(F.col("present"), F.col("rows"))
    summary = counts.groupBy("i").agg(
        F.coalesce(F.sum(here), F.lit(0)).alias("present_rows"),
        F.count(here).alias("distinct_values"),
        F.max(here).alias("largest"),
        F.min(here).alias("smallest"),
    )
    labels = F.array(*(F.lit(c) for c in columns))
    return summary.select(
        labels[F.col("i")].alias("column"), "present_rows", "distinct_values", "largest", "smallest"
    )


_LANE_TYPE = {"long": "bigint", "double": "double", "string": "string"}


def uniqueness_from(summary: DataFrame) -> Column:
    return ratio(summary["distinct_values"], summary["present_rows"])


def uniqueness_rate(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Distinct present values over present values; `approx` counts them with a sketch."""
    name = "uniqueness_rate"
    if column not in df.columns:
        return metric_row(df, name, F.lit(0.0))
    if approx:
        return _approximate_uniqueness(df, column)
    summary = value_summary(df, [column])
    return metric_row(summary, name, F.coalesce(F.max(uniqueness_from(summary)), F.lit(0.0)))


def _approximate_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Sketches are merged within groups of tasks first, then over the groups."""
    cells = df.select(
        F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"),
        V.key(df, column).cast("string").alias("cell"),
    )
    grouped = cells.groupBy("g").agg(F.hll_sketch_agg("cell", 14).alias("sketch"), F.count("cell").alias("rows"))
    distinct = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return metric_row(grouped, "uniqueness_rate", F.least(F.lit(1.0), ratio(distinct, F.coalesce(F.sum("rows"), F.lit(0)))))


# -- outliers -----------------------------------------------------------------------------------


def outlier_rates(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Per column `(column, value)`: share of the numeric values that are outliers.

    `iqr`: strictly outside the quartiles by more than 1.5 times their distance, quartiles exact
    and linearly interpolated. Any other method: more than three population standard deviations
    from the mean. The limits reach the counting scan as one scalar shared by all columns; wide
    tables go some columns at a time, as every column has a sketch of its own.
    """
    if len(columns) > SKETCHED_TOGETHER:
        parts = [
            outlier_rates(df, columns[i : i + SKETCHED_TOGETHER], method, accuracy)
            for i in range(0, len(columns), SKETCHED_TOGETHER)
        ]
        return functools.reduce(DataFrame.unionAll, parts)
    numbers = {c: V.number(df, c) for c in columns}
    if method == "iqr":
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
        reach = (q3 - q1) * 1.5
        limits = (
            order_statistics(df, numbers, [0.25, 0.75], accuracy=accuracy)
            # one entry per audited column
            .agg(
                F.map_from_entries(
                    F.collect_list(
                        F.struct("column", F.struct((q1 - reach).alias("low"), (q3 + reach).alias("high")))
                    )
                ).alias("by_column")
            )
            .select(F.array(*(F.try_element_at("by_column", F.lit(c)) for c in columns)))
        )
    else:
        limits = df.agg(
            F.array(
                *(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread")) for v in numbers.values())
            )
        )
    # the limits enter the rows as one scalar, planned once for all columns
    rows = df.select(*(v.alias(f"v{i}") for i, v in enumerate(numbers.values())), limits.scalar().alias("limits"))

    def outside(i: int) -> Column:
        v, limit = F.col(f"v{i}"), F.col("limits")[i]
        if method == "iqr":
            return (v < limit["low"]) | (v > limit["high"])
        return F.abs(F.try_divide(v - limit["mean"], limit["spread"])) > 3

    counted = rows.agg(
        F.array(
            *(
                F.struct(F.lit(c).alias("column"), ratio(F.count_if(outside(i)), F.count(f"v{i}")).alias("value"))
                for i, c in enumerate(numbers)
            )
        ).alias("rates")
    )
    return counted.select(F.inline("rates"))


def outlier_rate(df: DataFrame, column: str, method: str = "iqr", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    if column not in df.columns:
        return metric_row(df, "outlier_rate", F.lit(0.0))
    return outlier_rates(df, [column], method, accuracy).select(F.lit("outlier_rate").alias("metric"), "value")


# -- duplicates between tables ------------------------------------------------------------------


def shared_columns(*tables: DataFrame) -> list[str]:
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]


def rows_by_table(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """One row per distinct combination of `columns` (missing equals missing) with its row count
    in each table as `n0, n1, …`.

    One shuffle for all tables and no join: equal rows are counted before they are shuffled, so
    neither a row repeated a billion times nor a wide one makes a hot partition.
    """
    unioned = None
    for i, table in enumerate(tables):
        keys = [_common_key(tables, table, c).alias(f"k{j}") for j, c in enumerate(columns)]
        marks = [F.lit(1 if i == j else 0).cast("bigint").alias(f"n{j}") for j in range(len(tables))]
        part = table.select(*keys, *marks)
        unioned = part if unioned is None else unioned.unionAll(part)
    return unioned.groupBy(*(f"k{j}" for j in range(len(columns)))).agg(
        *(F.sum(f"n{j}").alias(f"n{j}") for j in range(len(tables)))
    )


def _common_key(tables: Sequence[DataFrame], table: DataFrame, column: str) -> Column:
    """A key of equal type in all tables, equal exactly where the values are: numbers of different types never meet as
    DOUBLE, which would make neighbours of large whole numbers equal."""
    kinds = [V.data_type(t, column) for t in tables]
    key = V.key(table, column)
    if all(k == kinds[0] for k in kinds):
        return key
    if not all(isinstance(k, T.NumericType) for k in kinds):
        raise ValueError(f"column {column!r} has types without a common one: {[k.simpleString() for k in kinds]}")
    if all(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
        return key.cast("double")
    if all(isinstance(k, V.INTEGRAL) for k in kinds):
        return key.cast("bigint")
    if all(isinstance(k, (*V.INTEGRAL, T.DecimalType)) for k in kinds):
        decimals = [k if isinstance(k, T.DecimalType) else T.DecimalType(19, 0) for k in kinds]
        scale = max(d.scale for d in decimals)
        precision = scale + max(d.precision - d.scale for d in decimals)
        if precision <= 38:
            return key.cast(T.DecimalType(precision, scale))
    return V.canonical_number(table, column)


def _overlap(i: int, j: int) -> Column:
    both = F.count_if((F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0))
    return ratio(both, F.coalesce(F.sum(f"n{i}"), F.lit(0)))


def exact_duplicate_overlap_rate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows, over the shared columns, that occur in both tables / all rows of the left."""
    name, columns = "exact_duplicate_overlap_rate", shared_columns(left, right)
    if not columns:
        return metric_row(left, name, F.lit(0.0))
    return metric_row(rows_by_table([left, right], columns), name, _overlap(0, 1))


def exact_duplicate_overlap_rate_across_splits(
    train: DataFrame, test: DataFrame, val: DataFrame | None = None
) -> DataFrame:
    """Overlap of every ordered pair of splits as rows `(pair, value)`."""
    tables = {"train": train, "test": test} | ({"val": val} if val is not None else {})
    names = list(tables)
    # "a_b" is named after the split searched first; its rate is over the rows of the other one,
    # except for pairs with the validation split, whose rate is over the rows of the first.
    over = {"train_test": ("test", "train"), "test_train": ("train", "test")}
    if val is not None:
        for a, b in (("val", "train"), ("train", "val"), ("val", "test"), ("test", "val")):
            over[f"{a}_{b}"] = (a, b)
    column_sets = {tuple(sorted(shared_columns(tables[a], tables[b]))) for a, b in over.values()}
    if len(column_sets) == 1 and column_sets != {()}:
        together = rows_by_table(list(tables.values()), shared_columns(*tables.values()))
        rates = [
            F.struct(
                F.lit(f"{pair}_overlap").alias("pair"), _overlap(names.index(a), names.index(b)).alias("value")
            )
            for pair, (a, b) in over.items()
        ]
        return together.agg(F.array(*rates).alias("rates")).select(F.inline("rates"))
    out = None
    for pair, (a, b) in over.items():
        one = exact_duplicate_overlap_rate(tables[a], tables[b]).select(
            F.lit(f"{pair}_overlap").alias("pair"), "value"
        )
        out = one if out is None else out.unionAll(one)
    return out
