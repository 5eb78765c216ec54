"""Tables of a relational database through Spark's JDBC source.

Reads are split over executors by `partition_column` and its bounds; filters, columns and the
random sample are left to the database. The catalog queries are PostgreSQL's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkassay.functions.values import serialize_rows


def reader_options(url: str, **options: str | int) -> dict[str, str]:
    """Options of the JDBC source; the url must name a database."""
    path = url.split("://", 1)[-1]
    if "/" not in path or not path.rsplit("/", 1)[-1].split("?", 1)[0]:
        raise ValueError("the url must end in a database name, as in jdbc:postgresql://host:port/database")
    return {"url": url} | {k: str(v) for k, v in options.items()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**reader_options(url, **options)).option("query", query).load()


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """A whole table, read in parallel ranges of `partition_column` when it is given."""
    reader = spark.read.format("jdbc").options(**reader_options(url, **options)).option("dbtable", table)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(partitions or spark.sparkContext.defaultParallelism),
        )
    return reader.load()


def tables_query(schema: str = "public") -> str:
    return (
        "SELECT table_name FROM information_schema.tables "
        f"WHERE table_type = 'BASE TABLE' AND table_schema = {literal(schema)}"
    )


def stats_query(table: str, schema: str = "public") -> str:
    """Estimated rows and bytes including indexes; no row for an absent table."""
    return (
        "SELECT CAST(greatest(t.reltuples, 0) AS bigint) AS row_count, "
        "pg_total_relation_size(t.oid) AS size_bytes "
        "FROM pg_catalog.pg_class t INNER JOIN pg_catalog.pg_namespace s ON t.relnamespace = s.oid "
        f"WHERE t.relname = {literal(table)} AND s.nspname = {literal(schema)}"
    )


def foreign_keys_query(table: str, schema: str = "public") -> str:
    return (
        "SELECT k.constraint_name, k.column_name, r.table_name AS ref_table, r.column_name AS ref_column "
        "FROM information_schema.referential_constraints c "
        "JOIN information_schema.key_column_usage k "
        "ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name "
        "JOIN information_schema.key_column_usage r "
        "ON r.constraint_schema = c.unique_constraint_schema AND r.constraint_name = c.unique_constraint_name "
        "AND r.ordinal_position = k.position_in_unique_constraint "
        f"WHERE k.table_schema = {literal(schema)} AND k.table_name = {literal(table)}"
    )


def sample_query(table: str, percentage: float = 10.0, schema: str | None = None) -> str:
    """Random rows of a table; without a schema the database's search path finds it."""
    source = f"{quoted(schema)}.{quoted(table)}" if schema else quoted(table)
    return f"SELECT * FROM {source} ORDER BY RANDOM() LIMIT {max(10, int(percentage))}"


def list_tables(spark: SparkSession, url: str, schema: str = "public", **options) -> DataFrame:
    return _query(spark, url, tables_query(schema), **options)


def table_stats(spark: SparkSession, url: str, table: str, schema: str = "public", **options) -> DataFrame:
    return _query(spark, url, stats_query(table, schema), **options)


def foreign_keys(spark: SparkSession, url: str, table: str, schema: str = "public", **options) -> DataFrame:
    return _query(spark, url, foreign_keys_query(table, schema), **options)


def sample_table(
    spark: SparkSession, url: str, table: str, percentage: float = 10.0, schema: str | None = None, **options
) -> DataFrame:
    """max(10, int(percentage)) random rows, drawn by the database, in JSON-friendly values."""
    return serialize_rows(_query(spark, url, sample_query(table, percentage, schema), **options))


def sample_database(
    spark: SparkSession, url: str, schema: str = "public", percentage: float = 10.0, **options
) -> dict[str, DataFrame]:
    names = [r["table_name"] for r in list_tables(spark, url, schema, **options).collect()]
    return {n: sample_table(spark, url, n, percentage, schema, **options) for n in names}


def open_database(
    spark: SparkSession, url: str, schema: str = "public", partitioned: dict[str, dict] | None = None, **options
) -> dict[str, DataFrame]:
    """All tables of a schema; `options` reach the JDBC reader. `partitioned` maps a table to what
    splits its read (partition_column, lower_bound, upper_bound, partitions); others are one task each."""
    names = [r["table_name"] for r in list_tables(spark, url, schema, **options).collect()]
    split = partitioned or {}
    return {n: read_table(spark, url, f"{quoted(schema)}.{quoted(n)}", **options, **split.get(n, {})) for n in names}
