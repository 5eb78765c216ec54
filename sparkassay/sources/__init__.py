"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkassay.sources import files, jdbc


def open_source(spark: SparkSession, kind: str, **options: Any) -> dict[str, DataFrame]:
    """Every table of a source by name. Kinds: `file` (path), `documents` (path of a folder with
    one folder or file of JSON lines per collection) and `jdbc` (url and reader options)."""
    if kind not in KINDS:
        raise ValueError(f"unknown source kind {kind!r}, expected one of {sorted(KINDS)}")
    return KINDS[kind](spark, **options)


KINDS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "file": files.open_file,
    "documents": files.open_documents,
    "jdbc": jdbc.open_database,
}
