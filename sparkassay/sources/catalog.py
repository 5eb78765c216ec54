"""What a set of tables is: names, columns, sizes and declared foreign keys."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.operators.quality import rows_by_table

FOREIGN_KEY_TYPE = "array<struct<columns:array<string>,ref_table:string,ref_columns:array<string>>>"


class ForeignKey(NamedTuple):
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of a folder by file name, `(table_name, files, size_bytes)`; only file listings are
    read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
        .select("path", "length")
    )
    inside = re.sub(r"^[a-z0-9]+:/*(?=/)", "", folder.rstrip("/"))
    name = F.regexp_extract("path", re.escape(inside) + r"/+([^/]+?)(?:\.parquet)?(?:/.*)?$", 1)
    return files.groupBy(name.alias("table_name")).agg(
        F.count("*").alias("files"), F.sum("length").alias("size_bytes")
    )


def counted_files(df: DataFrame) -> DataFrame | None:
    """One row `(row_count, size_bytes)` of a table read from files, None for any other.

    Path and size of its file travel with every row as the source's hidden columns; rows are counted by file in the
    tasks, so only sums come to the driver. A file without rows does not count."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    except AnalysisException:
        return None
    by_file = files.groupBy("path").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    none = F.lit(0).cast("long")
    return by_file.agg(F.coalesce(F.sum("rows"), none).alias("row_count"), F.coalesce(F.sum("size"), none).alias("size_bytes"))


def size_of(df: DataFrame) -> DataFrame | None:
    """One row `(size_bytes)`: bytes of the files that hold a table's rows; None if it has no files."""
    counted = counted_files(df)
    return None if counted is None else counted.select("size_bytes")


def table_metadata(tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey] = ()) -> DataFrame:
    """One row per table: `(table_name, columns, foreign_keys, row_count, size_bytes)`."""
    parts = []
    for name, df in tables.items():
        columns = F.array(
            *(
                F.struct(
                    F.lit(f.name).alias("name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.nullable).alias("is_nullable"),
                    F.lit(f.metadata.get("comment", "")).alias("comment"),
                )
                for f in df.schema.fields
            )
        )
        keys = F.array(
            *(
                F.struct(
                    F.array(*map(F.lit, k.columns)).alias("columns"),
                    F.lit(k.ref_table).alias("ref_table"),
                    F.array(*map(F.lit, k.ref_columns)).alias("ref_columns"),
                )
                for k in foreign_keys
                if k.table == name
            )
        ).cast(FOREIGN_KEY_TYPE)
        counted = counted_files(df)
        if counted is None:
            counted = df.agg(F.count("*").alias("row_count"), F.lit(0).cast("long").alias("size_bytes"))
        parts.append(
            counted.select(
                F.lit(name).alias("table_name"), columns.alias("columns"), keys.alias("foreign_keys"), "row_count", "size_bytes"
            )
        )
    return functools.reduce(DataFrame.unionAll, parts)


def dataset_size(metadata: DataFrame) -> DataFrame:
    """Totals over the tables: `(tables, row_count, size_bytes)`."""
    return metadata.agg(
        F.count("*").alias("tables"), F.sum("row_count").alias("row_count"), F.sum("size_bytes").alias("size_bytes")
    )


def column_catalog(spark: SparkSession, tables: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
    """Columns of all tables as rows `(table, table_no, column, ordinal)`; as many rows as the
    schemas have columns."""
    rows = []
    for t, (name, columns) in enumerate(tables.items()):
        names = columns.columns if isinstance(columns, DataFrame) else columns
        rows += [(name, t, c, i) for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "table string, table_no int, column string, ordinal int")


def foreign_key_check(tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """Rows `(key, rows, orphans)`: for every declared key the child rows with a whole key and
    those of them without a parent.

    Child and parent keys are counted together by key value: one shuffle of pre-counted keys, so
    neither a child value that fills the table nor an unindexed parent needs a join.
    """
    parts = []
    for k in foreign_keys:
        names = [f"k{i}" for i in range(len(k.columns))]
        child, parent = tables[k.table], tables[k.ref_table]
        child = child.select(*(V.col(c).alias(n) for c, n in zip(k.columns, names, strict=True))).dropna()
        parent = parent.select(*(V.col(c).alias(n) for c, n in zip(k.ref_columns, names, strict=True))).dropna()
        label = f"{k.table}({', '.join(k.columns)}) -> {k.ref_table}({', '.join(k.ref_columns)})"
        parts.append(
            rows_by_table([child, parent], names)
            .agg(
                F.coalesce(F.sum("n0"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(F.col("n1") == 0, F.col("n0"))), F.lit(0)).alias("orphans"),
            )
            .select(F.lit(label).alias("key"), "rows", "orphans")
        )
    return functools.reduce(DataFrame.unionAll, parts)
