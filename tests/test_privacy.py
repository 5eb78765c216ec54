"""Privacy metrics on hand-made tables; matches as Python's own expressions find them."""

import re

import pytest

from sparkassay.functions import patterns as P
from sparkassay.operators import privacy

TEXTS = [
    "write to jo.doe@example.com now", "a@b.c", "jo@example.c|m", "123-45-6789", "1123-45-6789", "555 123 4567",
    "5551234567", "1234-5678 9012-3456", "1234567890123456", "10.0.0.1", "1.2.3", "born 02/29/1999", "13/31/1999",
    "12-31-2049", "AB12345678", "ab12345678", "rec 123456", "rec 12345", "12345678", "22123456", "+21622123456",
    "0021652123456", "post 4000", "in 1999", "in 2045", "in 1899", "1234567/A/B/C/123", "https://x", "http://%zz",
    "http://%41", "ftp://x.y", "é12345678", "12345678é", "٣٣٣-٤٥-٦٧٨٩", "x" * 5000 + " 4000", "", "none",
    "https://" + "a.b" * 20000,
]


@pytest.mark.parametrize("name", sorted(P.PII_PATTERNS | P.PHI_PATTERNS | P.IDENTIFIER_PATTERNS))
def test_patterns_as_python_finds_them(spark, name):
    pattern = (P.PII_PATTERNS | P.PHI_PATTERNS | P.IDENTIFIER_PATTERNS)[name]
    t = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    got = [r[0] for r in t.select(P.found(t["t"], name, pattern)).collect()]
    assert got == [re.search(pattern, x) is not None for x in TEXTS]


@pytest.mark.parametrize("patterns", [P.PII_PATTERNS, P.PHI_PATTERNS, P.IDENTIFIER_PATTERNS])
def test_any_pattern(spark, patterns):
    t = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    got = [r[0] for r in t.select(P.any_found(t["t"], patterns)).collect()]
    assert got == [any(re.search(p, x) for p in patterns.values()) for x in TEXTS]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "jo@example.com", None, "x"), (2, None, "123-45-6789", "y"), (3, "none", "none", None)]
    return spark.createDataFrame(rows, "account_id bigint, email string, SSN string, note string")


def test_contamination(people, value):
    assert value(privacy.pii_contamination_rate(people)) == pytest.approx(2 / 6)
    assert value(privacy.pii_contamination_rate(people, ["email", "absent"])) == 0.5
    assert value(privacy.pii_contamination_rate(people, ["absent"])) == 0.0
    assert value(privacy.pii_contamination_rate(people.where("note = 'z'"))) == 0.0
    assert value(privacy.pii_phi_contamination_rate(people, ["account_id"])) == 0.0


def test_regulated_fields(people, value):
    assert value(privacy.pii_phiviolation_rate(people)) == pytest.approx(2 / 3)
    assert value(privacy.pii_phiviolation_rate(people, ["SSN", "dob"])) == pytest.approx(2 / 6)
    assert value(privacy.pii_phiviolation_rate(people, [])) == 0.0
    assert value(privacy.pii_phiviolation_rate(people.select("note"))) == 0.0
    assert value(privacy.raw_pii_field_count(people)) == 3


def test_risk_fields_and_flags(people):
    risks = {(r["column"], r["by_name"], r["matching"]) for r in privacy.pii_risk_fields({"p": people}).collect()}
    assert risks == {("account_id", True, 0), ("email", True, 1), ("SSN", True, 1)}
    flags = {(r["regulation"], r["column"], r["signal"], r["matching"]) for r in privacy.governance_flags({"p": people}).collect()}
    assert flags == {(law, c, c.lower(), None) for law in ("GDPR", "CCPA") for c in ("email", "SSN")}
    bare = people.select("account_id")
    assert privacy.governance_flags({"p": bare}).count() == 0
    assert privacy.detect_identifiers(people, ["absent"]).count() == 0
