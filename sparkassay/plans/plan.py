"""Evaluation plans as tables: `(plan_no, metric_name, target_columns, reasoning, source, params)`.

`target_columns` lists columns, is ["all"] for every column, or NULL for the table as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions.text import metric_key
from sparkassay.plans.registry import COLUMN, METRICS, names_to_metrics

PLAN_SCHEMA = (
    "plan_no bigint, metric_name string, target_columns array<string>, reasoning string, source string, "
    "params map<string,string>"
)


def plan_table(spark: SparkSession, items: Iterable[Any]) -> DataFrame:
    """A plan from dicts; groups (lists of dicts) are joined, their place becomes the source."""
    rows: list[tuple] = []

    def add(item: Mapping[str, Any], source: str | None) -> None:
        targets = item.get("target_columns")
        params = {k: str(v) for k, v in (item.get("params") or {}).items()}
        rows.append(
            (
                len(rows),
                item.get("metric_name"),
                list(targets) if targets is not None else None,
                item.get("reasoning", ""),
                item.get("source", source),
                params,
            )
        )

    for i, item in enumerate(items):
        if isinstance(item, Mapping):
            add(item, None)
        else:
            for one in item or ():
                add(one, f"group {i}")
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def plan_by_column(plan: DataFrame) -> DataFrame:
    """Rows `(column, metric_name, reasoning)`: what to compute per column, each metric once with
    the reasoning given first. Entries without a name or without columns are left out."""
    return (
        plan.where("metric_name IS NOT NULL AND metric_name <> ''")
        .select("plan_no", "metric_name", "reasoning", F.explode("target_columns").alias("column"))
        .groupBy("column", "metric_name")
        .agg(F.min_by("reasoning", "plan_no").alias("reasoning"))
    )


def lookup(entries: Mapping[str, Any], key: Column, kind: str = "string") -> Column:
    """Value of a small fixed mapping, NULL for other keys."""
    if not entries:
        return F.lit(None).cast(kind)
    literals = [F.lit(x) for pair in entries.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), key)


def executed_metric(name: Column) -> Column:
    """The registered metric behind a requested name, NULL if there is none."""
    return lookup(names_to_metrics(), metric_key(name))


def first_tables(tables: Mapping[str, Sequence[str] | DataFrame]) -> dict[str, str]:
    """Column -> the first table that holds it."""
    out: dict[str, str] = {}
    for name, columns in tables.items():
        for c in columns.columns if isinstance(columns, DataFrame) else columns:
            out.setdefault(c, name)
    return out


def resolve_plan(plan: DataFrame, tables: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
    """What a plan comes down to: rows `(plan_no, table, column, columns, requested_metric,
    executed_metric, reasoning, params, error_message)`.

    Every column-wise metric has one row per column ("all" is every column of every table), any
    other one row with all its columns; a plan entry without columns concerns every table as a
    whole. A table is found by its first column. Each (table, column, metric) is kept once, from
    the first entry that asks for it; entries that cannot run carry a message. Names and schemas
    are literals, so the only shuffle is the one that removes repetitions.
    """
    schemas = {t: list(c.columns if isinstance(c, DataFrame) else c) for t, c in tables.items()}
    shapes = {m.name: m.shape for m in METRICS.values()}
    arities = {m.name: m.arity for m in METRICS.values()}

    def spot(table: Column, columns: Column) -> Column:
        return F.struct(table.cast("string").alias("table"), columns.alias("columns"))

    no_columns = F.lit(None).cast("array<string>")
    nowhere = F.lit(None)
    every_column = F.array(*(spot(F.lit(t), F.array(F.lit(c))) for t, cs in schemas.items() for c in cs))
    every_table = F.array(*(spot(F.lit(t), no_columns) for t in schemas))
    targets = F.col("target_columns")
    home = first_tables(tables)
    each = F.transform(targets, lambda c: spot(lookup(home, c), F.array(c)))
    together = F.array(spot(lookup(home, targets[0]), targets))
    is_all = (F.size(targets) == 1) & (targets[0] == "all")
    by_column = F.col("shape") == COLUMN
    spots = (
        F.when(F.col("executed_metric").isNull(), F.array(spot(nowhere, targets)))
        .when(targets.isNull() | (F.size(targets) == 0), every_table)
        .when(is_all & by_column, every_column)
        .when(is_all, every_table)
        .when(by_column, each)
        .otherwise(together)
    )
    named = (
        plan.where("metric_name IS NOT NULL AND metric_name <> ''")
        .withColumn("executed_metric", executed_metric(F.col("metric_name")))
        .withColumn("shape", lookup(shapes, F.col("executed_metric")))
        .withColumn("arity", lookup(arities, F.col("executed_metric"), "int"))
    )
    placed = named.select("*", F.inline(spots))
    columns = F.col("columns")
    message = (
        F.when(
            F.col("executed_metric").isNull(),
            F.concat(F.lit("metric '"), F.col("metric_name"), F.lit("' is not registered")),
        )
        .when(
            F.col("table").isNull(),
            F.concat(F.lit("column '"), F.coalesce(columns[0], F.lit("")), F.lit("' is in no table")),
        )
        .when(
            (F.col("arity") > 0) & (F.coalesce(F.size(columns), F.lit(0)) != F.col("arity")),
            F.concat(F.lit("needs "), F.col("arity").cast("string"), F.lit(" columns")),
        )
    )
    label = F.coalesce(F.array_join(columns, ","), F.lit("all"))
    kept = F.struct(
        "plan_no", "table", "columns", F.col("metric_name").alias("requested_metric"), "reasoning", "params",
        message.alias("error_message"),
    )
    identity = F.coalesce("executed_metric", metric_key(F.col("metric_name")))
    return (
        placed.withColumn("kept", kept)
        .groupBy(
            F.col("table").alias("at"),
            label.alias("column"),
            "executed_metric",
            identity.alias("identity"),
            # entries with other parameters are other entries
            F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))).alias("with"),
        )
        .agg(F.min_by("kept", "plan_no").alias("kept"))
        .select("kept.*", "column", "executed_metric")
        .select(
            "plan_no", "table", "column", "columns", "requested_metric", "executed_metric", "reasoning", "params",
            "error_message",
        )
    )
