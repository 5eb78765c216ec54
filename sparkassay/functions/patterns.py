"""The patterns and words by which personal and health data are recognised.

Every pattern is searched for anywhere in a text. They are written for regular expressions whose
classes cover all of Unicode, so `found` turns that mode on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal data.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

# Health data.
PHI_PATTERNS = {
    "medical_record_num": r"\b[0-9]{6,10}\b",
    "date_of_birth": r"\b(0?[1-9]|1[0-2])[/-](0?[1-9]|[12][0-9]|3[01])[/-](19|20)\d{2}\b",
    "health_plan_beneficiary": r"\b[A-Z]{2}[0-9]{8,10}\b",
    "account_number": r"\b[0-9]{8,17}\b",
}

# Identifiers. The year-like numbers 19xx and 20xx are no postal codes. The address
# pattern stops after one host character: more of them cannot change whether it is found.
IDENTIFIER_PATTERNS = {
    "TUN_CIN": r"\b\d{8}\b",
    "TUN_PHONE": r"\b(?:(?:\+216|00216)?[24597]\d{7})\b",
    "TUN_POSTAL_CODE": r"\b(?!(?:19|20)\d{2}\b)\d{4}\b",
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "URL": r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))",
    "TUN_MATRICULE_FISCAL": r"\b\d{7}/[A-Z]/[A-Z]/[A-Z]/\d{3}\b",
}

# Words in column names.
PII_NAME_WORDS = ("ssn", "phone", "email", "credit", "card", "account", "mru", "dob", "medical")
REGULATED_NAME_WORDS = ("ssn", "mru", "dob", "medical")

# Signal -> regulations. A signal is a word in a column name or a PII pattern found
# in the column's values.
REGULATION_SIGNALS = {
    "ssn": ("CCPA", "GDPR"),
    "email": ("CCPA", "GDPR"),
    "ip_address": ("CCPA", "GDPR"),
    "credit_card": ("PCI-DSS",),
    "cvv": ("PCI-DSS",),
    "diagnos": ("HIPAA",),
    "icd": ("HIPAA",),
}

# What every match of a pattern holds somewhere; the plain search for it comes first.
_HOLDS = {"email": "@", "EMAIL_ADDRESS": "@", "URL": "://", "TUN_MATRICULE_FISCAL": "/"}
# Characters a match of a pattern can begin with; places with another one are left at once.
_BEGINS = {
    "ssn": r"\d",
    "phone": r"\d",
    "credit_card": r"\d",
    "ip_address": r"\d",
    "medical_record_num": "0-9",
    "date_of_birth": "0-9",
    "health_plan_beneficiary": "A-Z",
    "account_number": "0-9",
    "TUN_CIN": r"\d",
    "TUN_PHONE": r"+\d",
    "TUN_POSTAL_CODE": r"\d",
    "IP_ADDRESS": r"\d",
    "TUN_MATRICULE_FISCAL": r"\d",
}


def found(text: Column, name: str, pattern: str) -> Column:
    """True where the pattern occurs anywhere in the text."""
    return any_found(text, {name: pattern})


def any_found(text: Column, patterns: dict[str, str]) -> Column:
    """True where at least one of the patterns occurs in the text. Patterns whose first character
    is known are searched for together in one pass over the text."""
    together = {n: p for n, p in patterns.items() if n in _BEGINS and n not in _HOLDS}
    hits = []
    if together:
        first = "".join(sorted({_BEGINS[n] for n in together}))
        choice = "|".join(f"(?:{p})" for p in together.values())
        hits.append(text.rlike(f"(?U)(?=[{first}])(?:{choice})"))
    for name, pattern in patterns.items():
        if name in together:
            continue
        ahead = f"(?=[{_BEGINS[name]}])" if name in _BEGINS else ""
        match = text.rlike(f"(?U){ahead}(?:{pattern})")
        hits.append(F.contains(text, F.lit(_HOLDS[name])) & match if name in _HOLDS else match)
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out
