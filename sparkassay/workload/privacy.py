"""Privacy queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import patterns as P
from sparkassay.operators import privacy
from sparkassay.workload.tables import rounded, scalar_sql, table


def _tables(spark, folder):
    """Given tables, and one with sensitive names derived from customers and orders."""
    customers = table(spark, folder, "customer")
    people = customers.select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("Medical_Note"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") * 1001).alias("patient_DOB"),
        F.concat(F.lit("10.0."), F.col("c_nationkey"), F.lit("."), F.pmod("c_custkey", F.lit(250))).alias("origin"),
        F.when(
            F.col("c_custkey") % 3 == 0,
            F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@mail.example.org")),
        ).alias("contact"),
    )
    return {"people": people, "documents": table(spark, folder, "documents"), "orders": table(spark, folder, "orders")}


def pii_contamination_rate(spark, folder):
    return rounded(privacy.pii_contamination_rate(table(spark, folder, "documents")))


def pii_phi_contamination_rate(spark, folder):
    return rounded(privacy.pii_phi_contamination_rate(table(spark, folder, "documents"), ["text", "source", "absent"]))


def pii_phiviolation_rate(spark, folder):
    return rounded(privacy.pii_phiviolation_rate(_tables(spark, folder)["people"]))


def pii_phiviolation_rate_listed(spark, folder):
    fields = ["Medical_Note", "ssn", "patient_DOB", "contact"]
    return rounded(privacy.pii_phiviolation_rate(_tables(spark, folder)["people"], fields))


def raw_pii_field_count(spark, folder):
    return privacy.raw_pii_field_counts(_tables(spark, folder))


def detect_identifiers(spark, folder):
    return rounded(privacy.detect_identifiers(table(spark, folder, "documents"), ["text", "source"]), "rate")


def detect_identifiers_pages(spark, folder):
    return rounded(privacy.detect_identifiers(table(spark, folder, "pages"), ["url", "html", "absent"]), "rate")


def pattern_counts(spark, folder):
    """Every personal and health pattern by itself."""
    return rounded(
        privacy.pattern_counts(table(spark, folder, "documents"), ["text"], P.PII_PATTERNS | P.PHI_PATTERNS), "rate"
    )


def pii_risk_fields(spark, folder):
    return privacy.pii_risk_fields(_tables(spark, folder))


def governance_flags(spark, folder):
    return privacy.governance_flags(_tables(spark, folder))


def governance_flags_by_name(spark, folder):
    """Signals in names count whatever the cells hold; in other columns the cells count."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_ssn"), F.col("c_name").alias("Email"), F.col("c_mktsegment").alias("icd_code"),
        F.col("c_acctbal").alias("diagnosis_cost"), F.col("c_nationkey").alias("cvv2"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("u"), "c_custkey", F.lit("@mail.example.org"))).alias("note"),
    )
    return privacy.governance_flags({"customers": customers})


QUERIES = {
    "pii_contamination_rate": pii_contamination_rate,
    "pii_phi_contamination_rate": pii_phi_contamination_rate,
    "pii_phiviolation_rate": pii_phiviolation_rate,
    "pii_phiviolation_rate_listed": pii_phiviolation_rate_listed,
    "raw_pii_field_count": raw_pii_field_count,
    "detect_identifiers": detect_identifiers,
    "detect_identifiers_pages": detect_identifiers_pages,
    "pattern_counts": pattern_counts,
    "pii_risk_fields": pii_risk_fields,
    "governance_flags": governance_flags,
    "governance_flags_by_name": governance_flags_by_name,
}

_PEOPLE = """(SELECT c_custkey AS account_id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS medical_note,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 1001 END AS patient_dob,
    '10.0.' || c_nationkey || '.' || (c_custkey % 250) AS origin,
    CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey || '@mail.example.org' END AS contact FROM customer)"""


def _found(column: str, pattern: str) -> str:
    if "(?!" in pattern:  # no lookahead in SQL: take all four-digit numbers, leave out the years
        return (
            f"len(list_filter(regexp_extract_all({column}, '\\b\\d{{4}}\\b'), "
            "lambda x: NOT (x LIKE '19%' OR x LIKE '20%'))) > 0"
        )
    return f"regexp_matches({column}, '{pattern}')"


def _any(column: str, patterns: dict[str, str]) -> str:
    return "(" + " OR ".join(_found(column, p) for p in patterns.values()) + ")"


def _contamination(columns: list[str], patterns: dict[str, str]) -> str:
    hits = " + ".join(f"count(*) FILTER ({_any(c, patterns)})" for c in columns)
    return f"({hits}) / ({' + '.join(f'count({c})' for c in columns)})"


def _counts(source: str, columns: list[str], patterns: dict[str, str], label: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{name}' AS {label}, count({c}) AS cells, "
        f"count(*) FILTER ({_found(c, p)}) AS matching, "
        f"round(count(*) FILTER ({_found(c, p)}) / count({c}), 6) AS rate FROM {source}"
        for c in columns
        for name, p in patterns.items()
    )


def _risk(table_name: str, source: str, named: list[str], texts: dict[str, str]) -> str:
    rows = []
    for shown, c in ({n: n.lower() for n in named} | texts).items():
        hits = f"count(*) FILTER ({_any(c, P.PII_PATTERNS)})" if shown in texts else "0 * count(*)"
        rows.append(
            f"SELECT '{table_name}' AS \"table\", '{shown}' AS \"column\", {shown in named} AS by_name, "
            f"{hits} AS matching FROM {source}"
        )
    return " UNION ALL ".join(rows)


_TEXTS = {
    ("people", _PEOPLE): {"Medical_Note": "medical_note", "origin": "origin", "contact": "contact"},
    ("documents", "documents"): {c: c for c in ("text", "lang", "source")},
    ("orders", "orders"): {c: c for c in ("o_orderstatus", "o_orderpriority")},
}

ORACLE = {
    "pii_contamination_rate": scalar_sql(
        "pii_contamination_rate", _contamination(["text", "lang", "source"], P.PII_PATTERNS), "documents"
    ),
    "pii_phi_contamination_rate": scalar_sql(
        "pii_phi_contamination_rate", _contamination(["text", "source"], P.PHI_PATTERNS), "documents"
    ),
    "pii_phiviolation_rate": scalar_sql(
        "pii_phiviolation_rate", "(count(medical_note) + count(patient_dob)) / (2 * count(*))", _PEOPLE
    ),
    "pii_phiviolation_rate_listed": scalar_sql(
        "pii_phiviolation_rate",
        "(count(medical_note) + count(patient_dob) + count(contact)) / (4 * count(*))",
        _PEOPLE,
    ),
    "raw_pii_field_count": f"""
        SELECT 'people' AS "table", CAST(3 AS BIGINT) AS fields,
               count(account_id) + count(medical_note) + count(patient_dob) AS present_cells FROM {_PEOPLE}
        UNION ALL SELECT 'documents', 0, 0 * count(*) FROM documents
        UNION ALL SELECT 'orders', 0, 0 * count(*) FROM orders""",
    "detect_identifiers": _counts("documents", ["text", "source"], P.IDENTIFIER_PATTERNS, "identifier"),
    "detect_identifiers_pages": _counts("pages", ["url", "html"], P.IDENTIFIER_PATTERNS, "identifier"),
    "pattern_counts": _counts("documents", ["text"], P.PII_PATTERNS | P.PHI_PATTERNS, "pattern"),
    "pii_risk_fields": "SELECT * FROM ("
    + " UNION ALL ".join(
        _risk(name, source, ["account_id", "Medical_Note", "patient_DOB"] if name == "people" else [], texts)
        for (name, source), texts in _TEXTS.items()
    )
    + ") WHERE by_name OR matching > 0",
    "governance_flags": "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{regulation}' AS regulation, '{name}' AS \"table\", '{shown}' AS \"column\", '{signal}' AS signal, "
        f"count(*) FILTER ({_found(c, P.PII_PATTERNS[signal])}) AS matching FROM {source}"
        for (name, source), texts in _TEXTS.items()
        for shown, c in texts.items()
        for signal, regulations in P.REGULATION_SIGNALS.items()
        if signal in P.PII_PATTERNS
        for regulation in regulations
    )
    + ") WHERE matching > 0",
    "governance_flags_by_name": " UNION ALL ".join(
        [
            f"SELECT '{regulation}' AS regulation, 'customers' AS \"table\", '{column}' AS \"column\", '{signal}' AS signal, "
            "CAST(NULL AS BIGINT) AS matching"
            for column, signal in (
                ("customer_ssn", "ssn"), ("Email", "email"), ("icd_code", "icd"), ("diagnosis_cost", "diagnos"), ("cvv2", "cvv"),
            )
            for regulation in P.REGULATION_SIGNALS[signal]
        ]
        + [
            f"SELECT '{regulation}', 'customers', 'note', 'email', count(*) FROM customer WHERE c_custkey % 4 = 0"
            for regulation in P.REGULATION_SIGNALS["email"]
        ]
    ),
}
