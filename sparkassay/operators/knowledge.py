"""Lookups in the metric graph and normalisation of the fields that select in it.

The graph is two tables: nodes `(id, label, name, formula, threshold_pass, threshold_warn,
threshold_fail)` and edges `(src, type, dst)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics audited when the graph has no rule.
DEFAULT_METRICS = (
    ("Total Missing Value Rate", "Share of missing cells across the whole dataset."),
    ("Class Imbalance Ratio", "Ratio of majority to minority class counts in the target column."),
    ("Potential Target Leakage Candidate Count", "Count of feature columns suspiciously correlated with the target."),
    ("Raw PII Field Count", "Count of columns matching PII patterns."),
)

# Synonyms of field values.
FIELD_SYNONYMS = {
    "retail": "e_commerce_and_retail",
    "e-commerce": "e_commerce_and_retail",
    "structured": "tabular",
    "nlp": "text_nlp",
    "cv": "computer_vision",
}

# Parts of the task names that need a target column.
TASKS_WITH_TARGET = ("classif", "regress", "forecast")


def graph_labels(nodes: DataFrame, label: str) -> DataFrame:
    """Distinct names of the nodes of a label."""
    return nodes.where(F.col("label") == label).select("name").distinct()


def search_metrics(nodes: DataFrame, edges: DataFrame, domain: str, modality: str, task: str) -> DataFrame:
    """Metrics at the end of the path modality -TYPE-> task -WITH-> domain -GOT-> metric, with
    their formula and thresholds, one row a path.

    The search goes from frontier to frontier: the nodes reached, few as each step ends at nodes of one name, are
    one map from id to number of paths, a scalar that filters the edges where they lie. Edges are never joined by where they
    begin, so a node with most of the edges is no hot key; only the last step joins, by the metric's own id."""

    def named(label: str, name: str) -> DataFrame:
        return nodes.where((F.col("label") == label) & (F.col("name") == name.lower())).select("id")

    def frontier(counted: DataFrame) -> Column:
        """(id, paths) rows as one map."""
        return counted.agg(F.map_from_entries(F.collect_list(F.struct("id", "paths"))).alias("m")).scalar()

    def links(reached: Column, kind: str) -> DataFrame:
        """Edges that leave the frontier."""
        there = edges.where(F.col("type") == kind).select("dst", F.try_element_at(reached, F.col("src")).alias("paths"))
        return there.where("paths IS NOT NULL")

    def step(reached: Column, kind: str, label: str, name: str) -> Column:
        ends = named(label, name).agg(F.collect_set("id").alias("s")).scalar()
        arrived = links(reached, kind).where(F.array_contains(ends, F.col("dst")))
        return frontier(arrived.groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")))

    begun = frontier(named("MODALITY", modality).groupBy("id").agg(F.count("*").alias("paths")))
    at_domain = step(step(begun, "TYPE", "TASK", task), "WITH", "DOMAIN", domain)
    metrics = nodes.where(F.col("label") == "METRICS").select(
        "id", "name", "formula", "threshold_pass", "threshold_warn", "threshold_fail"
    )
    found = links(at_domain, "GOT").join(metrics, F.col("dst") == F.col("id"))
    each = F.explode(F.array_repeat(F.lit(1), F.col("paths").cast("int")))  # one row a path
    return found.select(*metrics.columns[1:], each.alias("_path")).drop("_path")


def metrics_or_default(found: DataFrame) -> DataFrame:
    """The metrics found, or the four defaults when there are none: `(name, description, formula)`."""
    columns = {f.name for f in found.schema.fields}
    described = F.col("description") if "description" in columns else F.lit("")
    mine = found.select("name", described.alias("description"), "formula")
    spark = found.sparkSession
    defaults = spark.createDataFrame([(n, d) for n, d in DEFAULT_METRICS], "name string, description string").select(
        "name", "description", F.lit(None).cast("string").alias("formula")
    )
    # one boolean decides, so no join
    anything = found.limit(1).agg(F.count("*") > 0).scalar()
    return mine.unionByName(defaults.where(~anything))


def canonical_field(candidate: Column) -> Column:
    """Lower case, without a prefix up to the last dot, synonyms resolved."""
    cleaned = F.lower(F.trim(F.regexp_replace(F.trim(candidate), r"^.*\.", "")))
    synonyms = F.create_map(*(F.lit(x) for pair in FIELD_SYNONYMS.items() for x in pair))
    return F.coalesce(F.try_element_at(synonyms, cleaned), cleaned)


def normalize_field(candidates: DataFrame, column: str, allowed: DataFrame, allowed_column: str = "name") -> DataFrame:
    """Rows `(candidate, rows, matched)`: every distinct candidate, how often it occurs and the
    allowed value it stands for ('' if none). White space does not count in the comparison.

    Candidates are reduced to distinct values before they meet the allowed ones, so a value that
    fills the table costs no more than a rare one.
    """

    def squeeze(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"\s+", ""))

    distinct = candidates.groupBy(F.col(column).alias("candidate")).agg(F.count("*").alias("rows"))
    known = allowed.groupBy(squeeze(F.col(allowed_column)).alias("same")).agg(
        F.min(F.trim(allowed_column)).alias("matched")
    )
    return (
        distinct.withColumn("same", squeeze(canonical_field(F.col("candidate"))))
        .join(known, "same", "left")
        .select("candidate", "rows", F.coalesce("matched", F.lit("")).alias("matched"))
    )


def needs_target(task: Column) -> Column:
    hit = None
    for part in TASKS_WITH_TARGET:
        one = F.contains(task, F.lit(part))
        hit = one if hit is None else hit | one
    return hit


def resolve_target(
    requests: DataFrame, columns: Sequence[str], task: str = "task", target: str = "target_column"
) -> DataFrame:
    """Requests with `needs_target` and `status`: known, specified_but_not_in_schema, not_required
    or required_but_unresolved. Without a schema (no columns) every named target is known."""
    needed = F.coalesce(needs_target(F.col(task)), F.lit(False))
    named = F.col(target).isNotNull() & (F.col(target) != "")
    known = F.col(target).isin(*columns) if columns else F.lit(True)
    status = (
        F.when(named & known, "known")
        .when(named, "specified_but_not_in_schema")
        .when(~needed, "not_required")
        .otherwise("required_but_unresolved")
    )
    return requests.withColumn("needs_target", needed).withColumn("status", status)
