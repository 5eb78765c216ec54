"""Metric-graph and field queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import knowledge as K
from sparkassay.workload.tables import table

DOMAIN, MODALITY, TASK = "Building", "ASIA", "nation_7"


def _graph(spark, folder):
    """Regions as modalities, nations as tasks, market segments as domains and orders as metrics."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")

    def node(df, label, key, name, formula=None, level=None):
        limit = level if level is not None else F.lit(None).cast("double")
        return df.select(
            F.concat(F.lit(label[0]), F.col(key).cast("string")).alias("id"),
            F.lit(label).alias("label"),
            F.lower(name).alias("name"),
            (formula if formula is not None else F.lit(None).cast("string")).alias("formula"),
            (limit * 0.5).alias("threshold_pass"),
            limit.alias("threshold_warn"),
            (limit * 2).alias("threshold_fail"),
        )

    segments = customer.select("c_mktsegment").distinct()
    nodes = (
        node(region, "MODALITY", "r_regionkey", F.col("r_name"))
        .unionAll(node(nation, "TASK", "n_nationkey", F.col("n_name")))
        .unionAll(node(segments, "DOMAIN", "c_mktsegment", F.col("c_mktsegment")))
        .unionAll(
            node(
                orders, "ORDER", "o_orderkey", F.concat(F.lit("Order "), "o_orderkey"),
                F.col("o_orderpriority"), F.col("o_totalprice"),
            ).withColumn("label", F.lit("METRICS"))
        )
    )

    def edge(df, kind, src, dst):
        return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))

    def ref(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    edges = (
        edge(nation, "TYPE", ref("M", "n_regionkey"), ref("T", "n_nationkey"))
        .unionAll(
            edge(
                customer.select("c_nationkey", "c_mktsegment").distinct(),
                "WITH", ref("T", "c_nationkey"), ref("D", "c_mktsegment"),
            )
        )
        .unionAll(
            edge(
                orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
                "GOT", ref("D", "c_mktsegment"), ref("O", "o_orderkey"),
            )
        )
    )
    return nodes, edges


def search_metrics(spark, folder):
    return K.search_metrics(*_graph(spark, folder), DOMAIN, MODALITY, TASK)


def metrics_or_default(spark, folder):
    """One path that exists and one that does not."""
    graph = _graph(spark, folder)
    found = K.metrics_or_default(K.search_metrics(*graph, DOMAIN, MODALITY, TASK))
    fallback = K.metrics_or_default(K.search_metrics(*graph, DOMAIN, "africa", TASK))
    return found.withColumn("path", F.lit("found")).unionByName(fallback.withColumn("path", F.lit("none")))


def graph_labels(spark, folder):
    nodes, _ = _graph(spark, folder)
    return (
        K.graph_labels(nodes, "DOMAIN")
        .withColumn("label", F.lit("DOMAIN"))
        .unionByName(K.graph_labels(nodes, "MODALITY").withColumn("label", F.lit("MODALITY")))
        .unionByName(K.graph_labels(nodes, "TASK").withColumn("label", F.lit("TASK")))
    )


# Made from the event type: prefixed, padded, a synonym, spaced and unknown.
FIELDS = {
    "click": "TaskCategory.CLASSIFICATION",
    "view": "  E-Commerce ",
    "purchase": "retail",
    "signup": "e commerce and unknown",
    "error": "NLP",
}
ALLOWED = ("classification", "regression ", "e_commerce_and_retail", "text_ nlp")


def normalize_field(spark, folder):
    pairs = [F.lit(x) for pair in FIELDS.items() for x in pair]
    candidates = table(spark, folder, "events").select(F.create_map(*pairs)[F.col("event_type")].alias("field"))
    allowed = spark.createDataFrame([(a,) for a in ALLOWED], "name string")
    return K.normalize_field(candidates, "field", allowed)


def resolve_target(spark, folder):
    """A request per event: its task and, for two of three users, a target column."""
    tasks = {"click": "binary_classification", "view": "clustering", "purchase": "regression", "signup": "ranking"}
    pairs = [F.lit(x) for pair in tasks.items() for x in pair]
    target = F.when(F.col("user_id") % 3 == 0, "o_totalprice").when(F.col("user_id") % 3 == 1, "churn")
    requests = table(spark, folder, "events").select(
        "event_id",
        F.coalesce(F.try_element_at(F.create_map(*pairs), "event_type"), F.lit("forecasting")).alias("task"),
        target.alias("target_column"),
    )
    return K.resolve_target(requests, table(spark, folder, "orders").columns)


QUERIES = {
    "search_metrics": search_metrics,
    "metrics_or_default": metrics_or_default,
    "graph_labels": graph_labels,
    "normalize_field": normalize_field,
    "resolve_target": resolve_target,
}

_FOUND = """
    SELECT lower('Order ' || o_orderkey) AS name, o_orderpriority AS formula, o_totalprice * 0.5 AS threshold_pass,
           o_totalprice AS threshold_warn, o_totalprice * 2 AS threshold_fail
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE lower(c_mktsegment) = 'building'
      AND EXISTS (SELECT 1 FROM customer c JOIN nation ON c.c_nationkey = n_nationkey
                  JOIN region ON n_regionkey = r_regionkey
                  WHERE lower(n_name) = 'nation_7' AND lower(r_name) = 'asia' AND lower(c.c_mktsegment) = 'building')"""

_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIELDS.items())

ORACLE = {
    "search_metrics": _FOUND,
    "metrics_or_default": f"SELECT name, '' AS description, formula, 'found' AS path FROM ({_FOUND})"
    + "".join(f" UNION ALL SELECT '{n}', '{d}', NULL, 'none'" for n, d in K.DEFAULT_METRICS),
    "graph_labels": """
        SELECT DISTINCT lower(c_mktsegment) AS name, 'DOMAIN' AS label FROM customer
        UNION ALL SELECT DISTINCT lower(r_name), 'MODALITY' FROM region
        UNION ALL SELECT DISTINCT lower(n_name), 'TASK' FROM nation""",
    "normalize_field": f"""
        SELECT candidate, count(*) AS rows, CASE trim(candidate)
                 WHEN 'TaskCategory.CLASSIFICATION' THEN 'classification'
                 WHEN 'E-Commerce' THEN 'e_commerce_and_retail' WHEN 'retail' THEN 'e_commerce_and_retail'
                 WHEN 'NLP' THEN 'text_ nlp' ELSE '' END AS matched
        FROM (SELECT CASE event_type {_CASES} END AS candidate FROM events) GROUP BY candidate""",
    "resolve_target": """
        WITH r AS (SELECT event_id,
                     CASE event_type WHEN 'click' THEN 'binary_classification' WHEN 'view' THEN 'clustering'
                       WHEN 'purchase' THEN 'regression' WHEN 'signup' THEN 'ranking' ELSE 'forecasting' END AS task,
                     CASE user_id % 3 WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'churn' END AS target_column FROM events)
        SELECT *, task LIKE '%classif%' OR task LIKE '%regress%' OR task LIKE '%forecast%' AS needs_target,
               CASE WHEN target_column = 'o_totalprice' THEN 'known'
                    WHEN target_column IS NOT NULL THEN 'specified_but_not_in_schema'
                    WHEN task IN ('clustering', 'ranking') THEN 'not_required'
                    ELSE 'required_but_unresolved' END AS status FROM r""",
}
