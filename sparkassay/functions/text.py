"""Text helpers: JSON inside free text, and normalised names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"```[\s\S]*?```"
# From the first opening bracket to the last matching kind of closing bracket.
_BARE = r"\{[\s\S]*\}|\[[\s\S]*\]"


def json_candidate(text: Column) -> Column:
    """The part of a text that should be JSON: a fenced block, else the text from its first
    bracket to its last; the trimmed text itself when it has neither."""
    cleaned = _strip(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    fenced = F.regexp_substr(cleaned, F.lit(_FENCE))
    inside = F.substring(fenced, F.lit(4), F.length(fenced) - 6)
    block = _strip(F.regexp_replace(inside, "^json", ""))
    body = F.coalesce(block, cleaned)
    inner = F.coalesce(F.regexp_substr(body, F.lit(_BARE)), body)
    return F.when(body.rlike(r"^[{\[]"), body).otherwise(inner)


def extract_json(text: Column) -> Column:
    """The JSON inside a free text as a VARIANT, NULL where there is none or it does not parse."""
    return F.try_parse_json(json_candidate(text))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def metric_key(name: Column) -> Column:
    """A metric name as registry key: lower case, runs of other characters as one underscore."""
    squeezed = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(squeezed, r"^_+|_+$", "")
