"""Data-quality queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import quality as Q
from sparkassay.workload.tables import LABELLED, labelled_documents, rounded, scalar_sql, table

URL_PATTERN = r"https://[a-z.]+/(en|fr)/\d+"


def completeness_rate(spark, folder):
    return rounded(Q.completeness_rate(labelled_documents(spark, folder), "quality"))


def completeness_rate_all(spark, folder):
    return rounded(Q.completeness_rate(labelled_documents(spark, folder)))


def uniqueness_rate(spark, folder):
    return rounded(Q.uniqueness_rate(table(spark, folder, "orders"), "o_custkey"))


def uniqueness_rate_text(spark, folder):
    return rounded(Q.uniqueness_rate(table(spark, folder, "documents"), "text"))


def format_validity_rate(spark, folder):
    return rounded(Q.format_validity_rate(table(spark, folder, "pages"), "url", URL_PATTERN))


def outlier_rate_iqr(spark, folder):
    return rounded(Q.outlier_rate(table(spark, folder, "events"), "value"))


def outlier_rate_zscore(spark, folder):
    return rounded(Q.outlier_rate(table(spark, folder, "events"), "value", "zscore"))


def outlier_rate_coerced(spark, folder):
    """A text column: mostly numbers, the rest is missing once coerced."""
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(
        F.when(F.col("p_partkey") % 11 == 0, F.lit("4.5e3")).otherwise(F.regexp_extract("p_brand", r"#(\d+)", 1))
    )
    return rounded(Q.outlier_rate(table(spark, folder, "part").select(size.alias("size")), "size"))


OUTLIER_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def outlier_rates(spark, folder):
    """All measures of a table at once, squared prices added for a long tail."""
    lines = table(spark, folder, "lineitem").withColumn("tail", F.pow("l_extendedprice", F.lit(3)))
    return rounded(Q.outlier_rates(lines, [*OUTLIER_COLUMNS, "tail"]))


def total_missing_value_rate(spark, folder):
    return rounded(Q.total_missing_value_rate(labelled_documents(spark, folder)))


EXPECTED = {"p_partkey": "int", "p_brand": "int", "p_size": "str", "p_retailprice": "float", "p_weight": "float"}


def schema_type_violations(spark, folder):
    return Q.schema_type_violations(table(spark, folder, "part"), EXPECTED)


def schema_type_violations_strict(spark, folder):
    return Q.schema_type_violations(table(spark, folder, "part"), EXPECTED, strict=True)


def exact_duplicate_overlap_rate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    even = docs.where("doc_id % 2 = 0").drop("doc_id")
    return rounded(Q.exact_duplicate_overlap_rate(even, docs.where("doc_id % 2 = 1").drop("doc_id")))


def exact_duplicate_overlap_rate_missing(spark, folder):
    """Missing cells match missing cells; the types of the key differ between the sides."""
    docs = labelled_documents(spark, folder)
    left = docs.where("doc_id % 3 = 0").select("lang", "quality", "toxic")
    right = docs.where("doc_id % 3 = 1").select(F.col("quality").cast("bigint").alias("quality"), "lang", "source")
    return rounded(Q.exact_duplicate_overlap_rate(left, right))


def duplicate_overlap_splits(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    train, test, val = (
        docs.where(part).drop("doc_id") for part in ("doc_id % 10 < 6", "doc_id % 10 IN (6, 7)", "doc_id % 10 > 7")
    )
    return rounded(Q.exact_duplicate_overlap_rate_across_splits(train, test, val))


QUERIES = {
    "completeness_rate": completeness_rate,
    "completeness_rate_all": completeness_rate_all,
    "uniqueness_rate": uniqueness_rate,
    "uniqueness_rate_text": uniqueness_rate_text,
    "format_validity_rate": format_validity_rate,
    "outlier_rate_iqr": outlier_rate_iqr,
    "outlier_rate_zscore": outlier_rate_zscore,
    "outlier_rate_coerced": outlier_rate_coerced,
    "outlier_rates": outlier_rates,
    "total_missing_value_rate": total_missing_value_rate,
    "schema_type_violations": schema_type_violations,
    "schema_type_violations_strict": schema_type_violations_strict,
    "exact_duplicate_overlap_rate": exact_duplicate_overlap_rate,
    "exact_duplicate_overlap_rate_missing": exact_duplicate_overlap_rate_missing,
    "duplicate_overlap_splits": duplicate_overlap_splits,
}

_CELLS = "count(doc_id) + count(text) + count(lang) + count(source) + count(n_chars) + count(quality) + count(toxic)"


def _iqr(source: str, column: str) -> str:
    return (
        f"(SELECT v, quantile_cont(v, 0.25) OVER () AS a, quantile_cont(v, 0.75) OVER () AS b "
        f"FROM (SELECT {column} AS v FROM {source}) WHERE v IS NOT NULL)"
    )


_OUTSIDE = "count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) / count(*)"
_SIZES = (
    "(SELECT TRY_CAST(CASE WHEN p_partkey % 7 = 0 THEN p_name WHEN p_partkey % 11 = 0 THEN '4.5e3' "
    "ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS DOUBLE) AS size FROM part)"
)
_SPLITS = {"train": "doc_id % 10 < 6", "test": "doc_id % 10 IN (6, 7)", "val": "doc_id % 10 > 7"}


def _overlap(over: str, other: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT text, lang FROM documents WHERE {over} "
        f"INTERSECT SELECT text, lang FROM documents WHERE {other})) "
        f"/ (SELECT count(*) FROM documents WHERE {over})"
    )


_PAIRS = {
    "train_test": ("test", "train"),
    "test_train": ("train", "test"),
    "val_train": ("val", "train"),
    "train_val": ("train", "val"),
    "val_test": ("val", "test"),
    "test_val": ("test", "val"),
}

ORACLE = {
    "completeness_rate": scalar_sql("completeness_rate", "count(quality) / count(*)", LABELLED),
    "completeness_rate_all": scalar_sql("completeness_rate", f"({_CELLS}) / (7 * count(*))", LABELLED),
    "uniqueness_rate": scalar_sql("uniqueness_rate", "count(DISTINCT o_custkey) / count(o_custkey)", "orders"),
    "uniqueness_rate_text": scalar_sql("uniqueness_rate", "count(DISTINCT text) / count(text)", "documents"),
    "format_validity_rate": scalar_sql(
        "format_validity_rate", f"count(*) FILTER (regexp_matches(url, '^(?:{URL_PATTERN})')) / count(url)", "pages"
    ),
    "outlier_rate_iqr": scalar_sql("outlier_rate", _OUTSIDE, _iqr("events", "value")),
    "outlier_rate_zscore": scalar_sql(
        "outlier_rate",
        "count(*) FILTER (abs(value - m) / s > 3) / count(*)",
        "(SELECT value, avg(value) OVER () AS m, stddev_pop(value) OVER () AS s FROM events)",
    ),
    "outlier_rate_coerced": scalar_sql("outlier_rate", _OUTSIDE, _iqr(_SIZES, "size")),
    "outlier_rates": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", round({_OUTSIDE}, 6) AS value FROM {_iqr('lineitem', column)}"
        for name, column in [*((c, c) for c in OUTLIER_COLUMNS), ("tail", "pow(l_extendedprice, 3)")]
    ),
    "total_missing_value_rate": scalar_sql(
        "total_missing_value_rate", f"(7 * count(*) - ({_CELLS})) / (7 * count(*))", LABELLED
    ),
    "schema_type_violations": scalar_sql("schema_type_violations", "1 + 0 * count(*)", "part"),
    "schema_type_violations_strict": scalar_sql(
        "schema_type_violations",
        "1 + max(CASE WHEN TRY_CAST(p_brand AS DOUBLE) IS NULL AND p_brand IS NOT NULL THEN 1 ELSE 0 END)",
        "part",
    ),
    "exact_duplicate_overlap_rate": "SELECT 'exact_duplicate_overlap_rate' AS metric, round("
    + _overlap("doc_id % 2 = 0", "doc_id % 2 = 1")
    + ", 6) AS value",
    "exact_duplicate_overlap_rate_missing": f"""
        SELECT 'exact_duplicate_overlap_rate' AS metric, round(
          (SELECT count(*) FROM (SELECT lang, quality FROM {LABELLED} WHERE doc_id % 3 = 0
                                 INTERSECT SELECT lang, quality FROM {LABELLED} WHERE doc_id % 3 = 1))
          / (SELECT count(*) FROM documents WHERE doc_id % 3 = 0), 6) AS value""",
    "duplicate_overlap_splits": " UNION ALL ".join(
        f"SELECT '{pair}_overlap' AS pair, round({_overlap(_SPLITS[a], _SPLITS[b])}, 6) AS value"
        for pair, (a, b) in _PAIRS.items()
    ),
}
