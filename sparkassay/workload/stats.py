"""Statistics, fairness and series queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import series, stats
from sparkassay.workload.tables import LABELLED, labelled_documents, rounded, scalar_sql, table


def r_squared(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 100 + 50000).alias("p")
    )
    return rounded(stats.r_squared(lines, "y", "p"))


def variance_inflation_factor(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(stats.variance_inflation_factor(lines, "l_extendedprice", ["l_quantity", "l_discount"]))


def variance_inflation_factors(spark, folder):
    lean = F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.5 + F.col("l_tax") * 100000
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", lean.alias("lean"))
    return rounded(stats.variance_inflation_factors(lines))


def population_stability_index(spark, folder):
    events = table(spark, folder, "events")
    before = events.where("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    after = events.where("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    return rounded(stats.population_stability_index(before, "value", after, "value"))


def population_stability_index_edges(spark, folder):
    """Whole numbers, so that many values lie on bin edges."""
    lines = table(spark, folder, "lineitem")
    returned, kept = lines.where("l_returnflag = 'R'"), lines.where("l_returnflag <> 'R'")
    return rounded(stats.population_stability_index(returned, "l_quantity", kept, "l_quantity", 7))


def _features(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_extendedprice",
        (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("leak"),
        (-F.col("l_extendedprice")).alias("mirror"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice") + F.col("l_tax")).alias("gaps"),
        "l_quantity",
        F.lit(1.0).alias("constant"),
        "l_returnflag",
    )


def target_leakage_count(spark, folder):
    features = ["leak", "gaps", "l_quantity", "constant", "l_returnflag"]
    return stats.target_leakage_count(_features(spark, folder), "l_extendedprice", features, 0.9)


def potential_target_leakage_candidate_count(spark, folder):
    return stats.potential_target_leakage_candidate_count(_features(spark, folder), "l_extendedprice")


def class_imbalance_ratio(spark, folder):
    return rounded(stats.class_imbalance_ratio(table(spark, folder, "documents"), "lang"))


def demographic_parity_disparity(spark, folder):
    return rounded(stats.demographic_parity_disparity(labelled_documents(spark, folder), "source", "quality"))


def change_point_score(spark, folder):
    """Daily revenue per order priority."""
    daily = (
        table(spark, folder, "orders")
        .groupBy("o_orderpriority", "o_orderdate")
        .agg(F.sum("o_totalprice").alias("revenue"))
    )
    return rounded(series.change_point_scores(daily, ["o_orderpriority"], "o_orderdate", "revenue"))


def change_point_score_long(spark, folder):
    """One long series with missing points, split into blocks."""
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") >= 10, F.col("value")).alias("value")
    )
    return rounded(series.change_point_detection_score(events, "event_id", "value", window_rows=1000))


def change_point_score_spike(spark, folder):
    """Series by user with spikes nine orders above the rest, in windows and in pieces of chunks."""
    value = F.when(F.col("event_id") % 1000 == 77, F.col("value") + 1e9).otherwise(F.col("value"))
    events = table(spark, folder, "events").select((F.col("event_id") % 3).alias("lane"), "event_id", value.alias("value"))
    return rounded(series.change_point_scores(events, ["lane"], "event_id", "value", piece=100))


QUERIES = {
    "r_squared": r_squared,
    "variance_inflation_factor": variance_inflation_factor,
    "variance_inflation_factors": variance_inflation_factors,
    "population_stability_index": population_stability_index,
    "population_stability_index_edges": population_stability_index_edges,
    "target_leakage_count": target_leakage_count,
    "potential_target_leakage_candidate_count": potential_target_leakage_candidate_count,
    "class_imbalance_ratio": class_imbalance_ratio,
    "demographic_parity_disparity": demographic_parity_disparity,
    "change_point_score": change_point_score,
    "change_point_score_long": change_point_score_long,
    "change_point_score_spike": change_point_score_spike,
}


def _vif(y: str, a: str, b: str) -> str:
    """Two predictors in closed form, from three correlations."""
    r1, r2, r12 = f"corr({y}, {a})", f"corr({y}, {b})", f"corr({a}, {b})"
    return f"1 / (1 - ({r1} * {r1} + {r2} * {r2} - 2 * {r1} * {r2} * {r12}) / (1 - {r12} * {r12}))"


def _psi(expected: str, actual: str, source: str, bins: int) -> str:
    """Bins by comparing with the edges; expected and actual are conditions on the rows."""
    return f"""
        WITH r AS (SELECT v, e, row_number() OVER () AS no FROM
                     (SELECT v, ({expected}) AS e FROM {source} WHERE ({expected}) OR ({actual}))),
             span AS (SELECT min(v) AS low, max(v) AS high FROM r),
             edges AS (SELECT i, CASE WHEN i = {bins} THEN high ELSE low + i * ((high - low) / {bins}) END AS edge
                       FROM span, generate_series(0, {bins}) AS t(i)),
             slots AS (SELECT a.i, a.edge AS low, b.edge AS high FROM edges a JOIN edges b ON b.i = a.i + 1),
             counts AS (SELECT s.i, count(*) FILTER (r.e) AS e, count(*) FILTER (NOT r.e) AS a FROM slots s
                        LEFT JOIN r ON r.v >= s.low AND (r.v < s.high OR (s.i = {bins - 1} AND r.v <= s.high))
                        GROUP BY s.i),
             shares AS (SELECT (e + 1e-10) / sum(e + 1e-10) OVER () AS e, (a + 1e-10) / sum(a + 1e-10) OVER () AS a
                        FROM counts)
        SELECT 'population_stability_index' AS metric, round(sum((a - e) * ln(a / e)), 6) AS value FROM shares"""


def _change_points(source: str, keys: str, group: str) -> str:
    """`source` gives (keys, t, v); the frame is as long as a fifth of the series."""
    over = f"OVER (PARTITION BY {group} ORDER BY t ROWS BETWEEN back PRECEDING AND ahead FOLLOWING)"
    return f"""
        WITH sized AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
             framed AS (SELECT *, greatest(2, n // 5) AS w, (greatest(2, n // 5) - 1) // 2 AS ahead,
                               greatest(2, n // 5) - 1 - (greatest(2, n // 5) - 1) // 2 AS back FROM sized),
             rolled AS (SELECT *, count(v) {over} AS c, avg(v) {over} AS m, stddev_samp(v) {over} AS s FROM framed)
        SELECT {keys} n, CASE WHEN n < 3 THEN 0 ELSE
               count(*) FILTER (c = w AND (v > m + 2 * s OR v < m - 2 * s)) / n END AS value
        FROM rolled GROUP BY {keys} n"""


_LEAKS = {
    "leak": "l_extendedprice * 2 + l_quantity",
    "mirror": "-l_extendedprice",
    "gaps": "CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice + l_tax END",
    "l_quantity": "l_quantity",
}


def _leakage(names: list[str], threshold: float) -> str:
    return " + ".join(
        f"(CASE WHEN abs(corr(l_extendedprice, {_LEAKS[n]})) >= {threshold} THEN 1 ELSE 0 END)" for n in names
    )


ORACLE = {
    "r_squared": scalar_sql(
        "r_squared",
        "1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))",
        "(SELECT l_extendedprice AS y, l_quantity * 100 + 50000 AS p FROM lineitem)",
    ),
    "variance_inflation_factor": scalar_sql(
        "variance_inflation_factor", _vif("l_extendedprice", "l_quantity", "l_discount"), "lineitem"
    ),
    "variance_inflation_factors": " UNION ALL ".join(
        f"SELECT '{y}' AS \"column\", round({_vif(y, a, b)}, 6) AS value FROM (SELECT l_quantity, l_extendedprice, "
        "l_quantity * 1000 + l_extendedprice * 0.5 + l_tax * 100000 AS lean FROM lineitem)"
        for y, a, b in (
            ("l_quantity", "l_extendedprice", "lean"),
            ("l_extendedprice", "l_quantity", "lean"),
            ("lean", "l_quantity", "l_extendedprice"),
        )
    ),
    "population_stability_index": _psi(
        "ts < TIMESTAMP '2024-01-16 00:00:00'",
        "ts >= TIMESTAMP '2024-01-16 00:00:00'",
        "(SELECT value AS v, ts FROM events)",
        10,
    ),
    "population_stability_index_edges": _psi(
        "l_returnflag = 'R'", "l_returnflag <> 'R'", "(SELECT l_quantity AS v, l_returnflag FROM lineitem)", 7
    ),
    "target_leakage_count": scalar_sql(
        "target_leakage_count", _leakage(["leak", "gaps", "l_quantity"], 0.9), "lineitem"
    ),
    "potential_target_leakage_candidate_count": scalar_sql(
        "potential_target_leakage_candidate_count",
        _leakage(["leak", "mirror", "gaps", "l_quantity"], 0.95),
        "lineitem",
    ),
    "class_imbalance_ratio": scalar_sql(
        "class_imbalance_ratio", "max(n) / min(n)", "(SELECT count(*) AS n FROM documents GROUP BY lang)"
    ),
    "demographic_parity_disparity": scalar_sql(
        "demographic_parity_disparity",
        "max(rate) - min(rate)",
        f"(SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS rate FROM {LABELLED} GROUP BY source)",
    ),
    "change_point_score": "SELECT o_orderpriority, n AS points, round(value, 6) AS value FROM ("
    + _change_points(
        "(SELECT o_orderpriority, o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL)",
        "o_orderpriority,",
        "o_orderpriority",
    )
    + ")",
    "change_point_score_long": "SELECT 'change_point_detection_score' AS metric, round(value, 6) AS value FROM ("
    + _change_points(
        "(SELECT event_id AS t, CASE WHEN event_id >= 10 THEN value END AS v FROM events)", "", "1"
    )
    + ")",
    "change_point_score_spike": "SELECT lane, n AS points, round(value, 6) AS value FROM ("
    + _change_points(
        "(SELECT event_id % 3 AS lane, event_id AS t, CASE WHEN event_id % 1000 = 77 THEN value + 1e9 ELSE value END AS v FROM events)",
        "lane,",
        "lane",
    )
    + ")",
}
