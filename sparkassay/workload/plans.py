"""Plan and audit queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import patterns as P
from sparkassay.plans.audit import audit, summarize
from sparkassay.plans.plan import plan_by_column as by_column
from sparkassay.operators.ranks import new_folder
from sparkassay.plans.plan import resolve_plan as resolve
from sparkassay.plans.registry import compute
from sparkassay.sources.session import SessionTables
from sparkassay.workload.privacy import _contamination
from sparkassay.workload.quality import _OUTSIDE, _iqr
from sparkassay.workload.sources import COLUMNS
from sparkassay.workload.stats import _psi, _vif
from sparkassay.workload.tables import LABELLED, labelled_documents, rounded, table

# -- plans made of events -----------------------------------------------------------------------

REQUESTS = {
    "click": "Null Rate",
    "view": "vif",
    "purchase": "Outlier-Rate",
    "signup": "Total Missing Value Rate",
    "error": "R Squared",
}


def event_plan(spark, folder):
    """A plan entry per event: the type says which metric, the user on which columns."""
    names = F.create_map(*(F.lit(x) for pair in REQUESTS.items() for x in pair))
    user = F.col("user_id")
    targets = (
        F.when(user % 5 == 0, F.array(F.lit("o_totalprice")))
        .when(user % 5 == 1, F.array(F.lit("all")))
        .when(user % 5 == 3, F.array(F.lit("c_acctbal"), F.lit("o_totalprice")))
        .when(user % 5 == 4, F.array(F.lit("nowhere")))
    )
    odd = (F.col("event_type") == "error") & (user % 2 == 1)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("plan_no"),
        F.when(odd, "Bogus").otherwise(names[F.col("event_type")]).alias("metric_name"),
        targets.alias("target_columns"),
        F.concat(F.lit("user "), user).alias("reasoning"),
        F.lit("events").alias("source"),
        F.lit(None).cast("map<string,string>").alias("params"),
    )


def plan_by_column(spark, folder):
    return by_column(event_plan(spark, folder))


def resolve_plan(spark, folder):
    schemas = {t: COLUMNS[t].split() for t in ("orders", "customer")}
    return resolve(event_plan(spark, folder), schemas).drop("columns", "params")


# -- audits -------------------------------------------------------------------------------------

PLAN = [
    [
        {"metric_name": "completeness_rate", "target_columns": ["all"], "reasoning": "baseline"},
        {"metric_name": "Uniqueness Rate", "target_columns": ["o_custkey", "c_name", "lang"]},
        {"metric_name": "Numerical Outlier Rate", "target_columns": ["o_totalprice", "c_acctbal", "n_chars"]},
        {
            "metric_name": "format_validity_rate",
            "target_columns": ["c_name"],
            "params": {"pattern": r"Customer#0000\d*[05]\b"},
        },
        {"metric_name": "duplicates", "target_columns": ["c_name"], "reasoning": "asked for twice"},
    ],
    [
        {"metric_name": "Total Missing Value Rate", "target_columns": None},
        {"metric_name": "Class Imbalance Ratio", "target_columns": ["quality", "o_orderstatus", "lang"]},
        {"metric_name": "Potential Target Leakage Candidate Count", "target_columns": ["o_totalprice"]},
        {"metric_name": "Raw PII Field Count", "target_columns": None},
    ],
    [
        {"metric_name": "VIF", "target_columns": ["o_totalprice"]},
        {"metric_name": "pii_contamination_rate", "target_columns": ["text", "source"]},
        {"metric_name": "demographic_parity_disparity", "target_columns": ["lang", "quality"]},
        {"metric_name": "r_squared", "target_columns": ["o_totalprice", "o_custkey"]},
        {"metric_name": "Population Stability Index", "target_columns": ["quality", "toxic"]},
        {"metric_name": "Gini Coefficient", "target_columns": ["o_totalprice"]},
        {"metric_name": "null_rate", "target_columns": ["nowhere"]},
        {"metric_name": "r_squared", "target_columns": ["c_acctbal"]},
    ],
]


def audited(spark, folder):
    return {
        "orders": table(spark, folder, "orders"),
        "customer": table(spark, folder, "customer"),
        "documents": labelled_documents(spark, folder),
    }


def audit_report(spark, folder):
    return rounded(audit(audited(spark, folder), PLAN, settle=["documents"]))


def audit_summary(spark, folder):
    return summarize(audit(audited(spark, folder), PLAN, settle=["documents"]))


def audit_duplicates(spark, folder):
    """An audit of splits, series and boxes: metrics with several tables or columns."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    parts = {"train": "doc_id % 10 < 6", "test": "doc_id % 10 IN (6, 7)", "val": "doc_id % 10 > 7"}
    tables = {n: documents.where(c).drop("doc_id") for n, c in parts.items()}
    tables["events"] = table(spark, folder, "events")
    plan = [
        {"metric_name": "exact_duplicate_overlap_rate", "target_columns": ["text"], "params": {"other": "test"}},
        {
            "metric_name": "exact_duplicate_overlap_rate_across_splits",
            "target_columns": ["text"],
            "params": {"train": "train", "test": "test", "val": "val"},
        },
        {"metric_name": "Change Point Detection Score", "target_columns": ["event_id", "value"]},
        {"metric_name": "outlier_rate", "target_columns": ["value"], "params": {"method": "zscore"}},
        {"metric_name": "exact_duplicate_overlap_rate", "target_columns": ["value"], "params": {"other": "none"}},
    ]
    return rounded(audit(tables, plan))


def audit_parameters(spark, folder):
    """Whole-table metrics on some columns, and one metric with several parameters."""
    tables = {"people": _sensitive(spark, folder), "orders": table(spark, folder, "orders")}
    tables["later"] = tables["orders"].where("o_orderkey % 3 = 0")
    plan = [
        {"metric_name": "total_missing_value_rate", "target_columns": ["contact_email", "note"]},
        {"metric_name": "total_missing_value_rate", "target_columns": ["note"]},
        {"metric_name": "total_missing_value_rate", "target_columns": None},
        {"metric_name": "raw_pii_field_count", "target_columns": ["contact_email", "note"]},
        {"metric_name": "raw_pii_field_count", "target_columns": ["account_no", "contact_email", "note"]},
        {"metric_name": "outlier_rate", "target_columns": ["o_totalprice"], "params": {"method": "zscore"}},
        {"metric_name": "outlier_rate", "target_columns": ["o_totalprice"]},
        {"metric_name": "exact_duplicate_overlap_rate", "target_columns": ["o_custkey", "o_orderstatus"], "params": {"other": "later"}},
        {"metric_name": "exact_duplicate_overlap_rate", "target_columns": ["o_orderkey"], "params": {"other": "later"}},
        {"metric_name": "schema_type_violations", "target_columns": ["note"], "params": {"strict": "true", "note": "int", "contact_email": "int"}},
    ]
    return rounded(audit(tables, plan))


def _sensitive(spark, folder):
    """Customers with contact columns, some of them missing."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_no"),
        F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit("@example.org"))).alias("contact_email"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("note"),
    )


def compute_metrics(spark, folder):
    """Metrics asked for by name, one call each, on the tables of a session."""
    sessions = SessionTables(spark, new_folder(spark, "sessions"))
    sessions.save("c", {"people": _sensitive(spark, folder), "orders": table(spark, folder, "orders")})
    tables = sessions.tables("c")
    calls = [
        ("people", "Null Rate", ["note"]), ("people", "duplicates", ["note"]), ("people", "Total Missing Value Rate", []),
        ("people", "raw_pii_field_count", []), ("people", "pii_contamination_rate", [["contact_email"]]),
        ("orders", "class imbalance ratio", ["o_orderstatus"]), ("orders", "R Squared", ["o_totalprice", "o_custkey"]),
        ("orders", "vif", ["o_totalprice", ["o_orderkey", "o_custkey"]]), ("orders", "Numerical Outlier Rate", ["o_totalprice"]),
    ]
    out = None
    for name, metric, args in calls:
        one = compute(tables, name, metric, *args).select(F.lit(name).alias("table"), F.lit(metric).alias("asked"), "metric", "value")
        out = one if out is None else out.unionAll(one)
    return rounded(out)


QUERIES = {
    "plan_by_column": plan_by_column,
    "resolve_plan": resolve_plan,
    "audit_report": audit_report,
    "audit_summary": audit_summary,
    "audit_duplicates": audit_duplicates,
    "audit_parameters": audit_parameters,
    "compute_metrics": compute_metrics,
}

_PLAN_SQL = """
    SELECT event_id AS plan_no,
           CASE WHEN event_type = 'error' AND user_id % 2 = 1 THEN 'Bogus' ELSE CASE event_type
             WHEN 'click' THEN 'Null Rate' WHEN 'view' THEN 'vif' WHEN 'purchase' THEN 'Outlier-Rate'
             WHEN 'signup' THEN 'Total Missing Value Rate' ELSE 'R Squared' END END AS metric_name,
           CASE user_id % 5 WHEN 0 THEN ['o_totalprice'] WHEN 1 THEN ['all'] WHEN 3 THEN ['c_acctbal', 'o_totalprice']
             WHEN 4 THEN ['nowhere'] END AS target_columns,
           'user ' || user_id AS reasoning FROM events"""

_CATALOG = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c" for t in ("orders", "customer") for c in COLUMNS[t].split()
)

_RESOLVE = f"""
    WITH p AS ({_PLAN_SQL}),
    c AS ({_CATALOG}),
    e AS (SELECT *, CASE metric_name WHEN 'Null Rate' THEN 'completeness_rate' WHEN 'vif' THEN 'variance_inflation_factor'
             WHEN 'Outlier-Rate' THEN 'outlier_rate' WHEN 'Total Missing Value Rate' THEN 'total_missing_value_rate'
             WHEN 'R Squared' THEN 'r_squared' END AS executed_metric,
             metric_name IN ('Null Rate', 'vif', 'Outlier-Rate') AS single FROM p),
    s AS (
      SELECT e.*, NULL AS t, target_columns AS cols FROM e WHERE executed_metric IS NULL
      UNION ALL SELECT e.*, x.t, NULL FROM e, (SELECT DISTINCT t FROM c) x
        WHERE executed_metric IS NOT NULL AND (target_columns IS NULL OR (target_columns = ['all'] AND NOT single))
      UNION ALL SELECT e.*, c.t, [c.c] FROM e, c WHERE target_columns = ['all'] AND single
      UNION ALL SELECT u.*, c.t, [u.one] FROM (SELECT *, unnest(target_columns) AS one FROM e
                        WHERE single AND target_columns <> ['all']) u LEFT JOIN c ON c.c = u.one
      UNION ALL SELECT e.*, c.t, target_columns FROM e LEFT JOIN c ON c.c = target_columns[1]
        WHERE executed_metric IS NOT NULL AND NOT single AND target_columns <> ['all'])"""
# one branch carries the single column it unnested; leave it out there
_RESOLVE = _RESOLVE.replace("SELECT u.*, c.t", "SELECT u.* EXCLUDE (one), c.t")


def _cell(table_name: str, column: str, requested: str, executed: str, value: str, source: str) -> str:
    return (
        f"SELECT '{table_name}' AS \"table\", '{column}' AS \"column\", '{requested}' AS requested_metric, "
        f"'{executed}' AS executed_metric, round(CAST({value} AS DOUBLE), 6) AS value, 'success' AS status, "
        f"CAST(NULL AS VARCHAR) AS error_message FROM {source}"
    )


def _error(table_name: str, column: str, requested: str, executed: str, message: str) -> str:
    text = message.replace("'", "''")
    return (
        f"SELECT {table_name}, '{column}', '{requested}', {executed}, CAST(NULL AS DOUBLE), 'error', '{text}'"
    )


_SOURCES = {"orders": "orders", "customer": "customer", "documents": LABELLED}
_AUDITED = {t: COLUMNS[t].split() for t in ("orders", "customer", "documents")}
_AUDITED["documents"] = [*_AUDITED["documents"], "quality", "toxic"]


def _imbalance(table_name: str, column: str) -> str:
    return _cell(
        table_name, column, "Class Imbalance Ratio", "class_imbalance_ratio", "max(n) / min(n)",
        f"(SELECT count(*) AS n FROM {_SOURCES[table_name]} WHERE {column} IS NOT NULL GROUP BY {column})",
    )


def _missing(table_name: str) -> str:
    cells = " + ".join(f"count({c})" for c in _AUDITED[table_name])
    n = len(_AUDITED[table_name])
    return f"({n} * count(*) - ({cells})) / ({n} * count(*))"


_ROWS = [
    *(
        _cell(t, c, "completeness_rate", "completeness_rate", f"count({c}) / count(*)", _SOURCES[t])
        for t, cs in _AUDITED.items()
        for c in cs
    ),
    *(
        _cell(t, c, "Uniqueness Rate", "uniqueness_rate", f"count(DISTINCT {c}) / count({c})", _SOURCES[t])
        for t, c in (("orders", "o_custkey"), ("customer", "c_name"), ("documents", "lang"))
    ),
    *(
        _cell(t, c, "Numerical Outlier Rate", "outlier_rate", _OUTSIDE, _iqr(t, c))
        for t, c in (("orders", "o_totalprice"), ("customer", "c_acctbal"), ("documents", "n_chars"))
    ),
    _cell(
        "customer", "c_name", "format_validity_rate", "format_validity_rate",
        r"count(*) FILTER (regexp_matches(c_name, '^(?:Customer#0000\d*[05]\b)')) / count(c_name)", "customer",
    ),
    *(
        _cell(t, "all", "Total Missing Value Rate", "total_missing_value_rate", _missing(t), s)
        for t, s in _SOURCES.items()
    ),
    *(_imbalance(t, c) for t, c in (("documents", "quality"), ("orders", "o_orderstatus"), ("documents", "lang"))),
    _cell(
        "orders", "o_totalprice", "Potential Target Leakage Candidate Count", "potential_target_leakage_candidate_count",
        "(abs(corr(o_totalprice, o_orderkey)) >= 0.95)::INT + (abs(corr(o_totalprice, o_custkey)) >= 0.95)::INT", "orders",
    ),
    *(_cell(t, "all", "Raw PII Field Count", "raw_pii_field_count", "0 * count(*)", s) for t, s in _SOURCES.items()),
    _cell(
        "orders", "o_totalprice", "VIF", "variance_inflation_factor", _vif("o_totalprice", "o_orderkey", "o_custkey"),
        "orders",
    ),
    _cell(
        "documents", "text,source", "pii_contamination_rate", "pii_contamination_rate",
        _contamination(["text", "source"], P.PII_PATTERNS), "documents",
    ),
    _cell(
        "documents", "lang,quality", "demographic_parity_disparity", "demographic_parity_disparity",
        "max(r) - min(r)",
        f"(SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS r FROM {LABELLED} GROUP BY lang)",
    ),
    _cell(
        "orders", "o_totalprice,o_custkey", "r_squared", "r_squared",
        "1 - sum(power(o_totalprice - o_custkey, 2)) / (var_pop(o_totalprice) * count(*))", "orders",
    ),
    _cell(
        "documents", "quality,toxic", "Population Stability Index", "population_stability_index", "max(value)",
        "("
        + _psi(
            "side = 0", "side = 1",
            "(SELECT CAST(quality AS DOUBLE) AS v, 0 AS side FROM labels UNION ALL "
            "SELECT CAST(toxic AS DOUBLE), 1 FROM labels)", 10,
        )
        + ")",
    ),
    _error("NULL", "o_totalprice", "Gini Coefficient", "NULL", "metric 'Gini Coefficient' is not registered"),
    _error("NULL", "nowhere", "null_rate", "'completeness_rate'", "column 'nowhere' is in no table"),
    _error("'customer'", "c_acctbal", "r_squared", "'r_squared'", "needs 2 columns"),
]


def _split_overlap(over: str, other: str) -> str:
    parts = {"train": "doc_id % 10 < 6", "test": "doc_id % 10 IN (6, 7)", "val": "doc_id % 10 > 7"}
    return (
        f"(SELECT count(*) FROM (SELECT text FROM documents WHERE {parts[over]} INTERSECT "
        f"SELECT text FROM documents WHERE {parts[other]})) / (SELECT count(*) FROM documents WHERE {parts[over]})"
    )


_CHANGE = """(SELECT count(*) FILTER (c = w AND (value > m + 2 * s OR value < m - 2 * s)) / count(*) AS value FROM
    (SELECT value, w, count(*) OVER f AS c, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM
       (SELECT event_id, value, n // 5 AS w, (n // 5 - 1) // 2 AS ahead, n // 5 - 1 - (n // 5 - 1) // 2 AS back
        FROM events, (SELECT count(*) AS n FROM events))
     WINDOW f AS (ORDER BY event_id ROWS BETWEEN back PRECEDING AND ahead FOLLOWING)))"""

_PEOPLE = """(SELECT c_custkey AS account_no, CASE WHEN c_custkey % 3 > 0 THEN c_name || '@example.org' END AS contact_email,
    CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS note FROM customer)"""


def _people(columns: str, metric: str, value: str) -> str:
    return _cell("people", columns, metric, metric, value, _PEOPLE)


def _later(columns: str) -> str:
    shared = f"(SELECT count(*) FROM (SELECT {columns} FROM orders INTERSECT SELECT {columns} FROM orders WHERE o_orderkey % 3 = 0))"
    name = "exact_duplicate_overlap_rate"
    return _cell("orders", columns.replace(" ", ""), name, name, "v", f"(SELECT {shared} / count(*) AS v FROM orders)")


def _all_missing(name: str, source: str, columns: str) -> str:
    listed = columns.split(",")
    cells = " + ".join(f"count({c})" for c in listed)
    label = "total_missing_value_rate"
    return _cell(name, "all", label, label, f"({len(listed)} * count(*) - ({cells})) / ({len(listed)} * count(*))", source)


def _asked(name: str, asked: str, metric: str, value: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"table\", '{asked}' AS asked, '{metric}' AS metric, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"
    )


ORACLE = {
    "compute_metrics": " UNION ALL ".join(
        [
            _asked("people", "Null Rate", "completeness_rate", "count(note) / count(*)", _PEOPLE),
            _asked("people", "duplicates", "uniqueness_rate", "count(DISTINCT note) / count(note)", _PEOPLE),
            _asked("people", "Total Missing Value Rate", "total_missing_value_rate",
                   "(3 * count(*) - count(account_no) - count(contact_email) - count(note)) / (3 * count(*))", _PEOPLE),
            _asked("people", "raw_pii_field_count", "raw_pii_field_count", "2 + 0 * count(*)", _PEOPLE),
            _asked("people", "pii_contamination_rate", "pii_contamination_rate",
                   "count(*) FILTER (contact_email LIKE '%@example.org') / count(contact_email)", _PEOPLE),
            _asked("orders", "class imbalance ratio", "class_imbalance_ratio", "max(n) / min(n)",
                   "(SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)"),
            _asked("orders", "R Squared", "r_squared",
                   "1 - sum(power(o_totalprice - o_custkey, 2)) / (var_pop(o_totalprice) * count(*))", "orders"),
            _asked("orders", "vif", "variance_inflation_factor", _vif("o_totalprice", "o_orderkey", "o_custkey"), "orders"),
            _asked("orders", "Numerical Outlier Rate", "outlier_rate", _OUTSIDE, _iqr("orders", "o_totalprice")),
        ]
    ),
    "audit_parameters": " UNION ALL ".join(
        [
            _people("contact_email,note", "total_missing_value_rate", "(2 * count(*) - count(contact_email) - count(note)) / (2 * count(*))"),
            _people("note", "total_missing_value_rate", "(count(*) - count(note)) / count(*)"),
            _all_missing("people", _PEOPLE, "account_no,contact_email,note"),
            _all_missing("orders", "orders", ",".join(COLUMNS["orders"].split())),
            _all_missing("later", "(SELECT * FROM orders WHERE o_orderkey % 3 = 0)", ",".join(COLUMNS["orders"].split())),
            _people("contact_email,note", "raw_pii_field_count", "1 + 0 * count(*)"),
            _people("account_no,contact_email,note", "raw_pii_field_count", "2 + 0 * count(*)"),
            _cell("orders", "o_totalprice", "outlier_rate", "outlier_rate", "count(*) FILTER (abs(v - m) / s > 3) / count(*)",
                  "(SELECT o_totalprice AS v, avg(o_totalprice) OVER () AS m, stddev_pop(o_totalprice) OVER () AS s FROM orders)"),
            _cell("orders", "o_totalprice", "outlier_rate", "outlier_rate", _OUTSIDE, _iqr("orders", "o_totalprice")),
            _later("o_custkey, o_orderstatus"),
            _later("o_orderkey"),
            _people("note", "schema_type_violations", "CAST(count(note) > 0 AS INTEGER)"),
        ]
    ),
    "plan_by_column": f"""
        SELECT "column", metric_name, arg_min(reasoning, plan_no) AS reasoning
        FROM (SELECT plan_no, metric_name, reasoning, unnest(target_columns) AS "column" FROM ({_PLAN_SQL}))
        GROUP BY "column", metric_name""",
    "resolve_plan": f"""{_RESOLVE},
        k AS (SELECT *, coalesce(array_to_string(cols, ','), 'all') AS label,
                     row_number() OVER (PARTITION BY t, coalesce(array_to_string(cols, ','), 'all'), metric_name
                                        ORDER BY plan_no) AS rn FROM s)
        SELECT plan_no, t AS "table", label AS "column", metric_name AS requested_metric, executed_metric, reasoning,
               CASE WHEN executed_metric IS NULL THEN 'metric ''' || metric_name || ''' is not registered'
                    WHEN t IS NULL THEN 'column ''' || cols[1] || ''' is in no table'
                    WHEN executed_metric = 'r_squared' AND coalesce(len(cols), 0) <> 2 THEN 'needs 2 columns'
               END AS error_message
        FROM k WHERE rn = 1""",
    "audit_report": " UNION ALL ".join(_ROWS),
    "audit_summary": f"""
        SELECT count(*) AS total_metrics_evaluated, count(*) FILTER (status = 'success') AS successful_evaluations,
               count(*) FILTER (status <> 'success') AS failed_evaluations, CAST(NULL AS INTEGER) AS plan_score,
               CAST(NULL AS VARCHAR) AS plan_status FROM ({" UNION ALL ".join(_ROWS)})""",
    "audit_duplicates": " UNION ALL ".join(
        [
            _cell("train", "text", "exact_duplicate_overlap_rate", "exact_duplicate_overlap_rate", "v",
                  f"(SELECT {_split_overlap('train', 'test')} AS v)"),
            *(
                _cell("train", f"{pair}_overlap", "exact_duplicate_overlap_rate_across_splits",
                      "exact_duplicate_overlap_rate_across_splits", "v", f"(SELECT {_split_overlap(a, b)} AS v)")
                for pair, a, b in (
                    ("train_test", "test", "train"), ("test_train", "train", "test"), ("val_train", "val", "train"),
                    ("train_val", "train", "val"), ("val_test", "val", "test"), ("test_val", "test", "val"),
                )
            ),
            _cell("events", "event_id,value", "Change Point Detection Score", "change_point_detection_score", "value", _CHANGE),
            _cell("events", "value", "outlier_rate", "outlier_rate", "count(*) FILTER (abs(value - m) / s > 3) / count(*)",
                  "(SELECT value, avg(value) OVER () AS m, stddev_pop(value) OVER () AS s FROM events)"),
            _error("'events'", "value", "exact_duplicate_overlap_rate", "'exact_duplicate_overlap_rate'",
                   "parameter 'other' must name a table"),
        ]
    ),
}
