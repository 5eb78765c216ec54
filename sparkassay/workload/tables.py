"""Tables the registered queries run on: the given ones, and views Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most of the label cells are missing."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded for comparison."""
    names = columns or ("value",)
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def scalar_sql(metric: str, value: str, source: str) -> str:
    return f"SELECT '{metric}' AS metric, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"
