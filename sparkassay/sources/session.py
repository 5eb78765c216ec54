"""Tables kept for a session: Parquet folders by session and table, with an expiry."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.operators.sampling import paginate

DEFAULT_TTL_SECONDS = 3600
_EXPIRES = "_expires_at"


class SessionTables:
    """Tables of sessions below one folder, `session_id=…/table_name=…/`, each with its own schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, session_id: str, table: str | None = None) -> str:
        path = f"{self.folder}/session_id={quote(session_id, safe='')}"
        return path if table is None else f"{path}/table_name={quote(table, safe='')}"

    def _expiry(self, session_id: str, table: str) -> str:
        """Where a table's expiry stands by itself: a table without rows has one as well."""
        return f"{self._path(session_id)}/expiry_of={quote(table, safe='')}"

    def save(self, session_id: str, tables: Mapping[str, DataFrame], ttl_seconds: int = DEFAULT_TTL_SECONDS) -> None:
        """Write the tables; they count as gone `ttl_seconds` after this call."""
        expires = F.timestamp_seconds(F.unix_timestamp() + ttl_seconds)
        for name, df in tables.items():
            df.withColumn(_EXPIRES, expires).write.mode("overwrite").parquet(self._path(session_id, name))
            one = self.spark.range(1).select(expires.alias(_EXPIRES))
            one.write.mode("overwrite").parquet(self._expiry(session_id, name))

    def names(self, session_id: str) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(session_id))
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(root))
        return sorted(unquote(n.split("=", 1)[1]) for n in found if n.startswith("table_name="))

    def stored(self, session_id: str, table: str) -> DataFrame:
        """The rows as saved, without expired ones."""
        if table not in self.names(session_id):
            raise ValueError(f"no table {table!r} in session {session_id!r}")
        rows = self.spark.read.parquet(self._path(session_id, table))
        return rows.where(F.col(_EXPIRES) > F.current_timestamp()).drop(_EXPIRES)

    def table(self, session_id: str, table: str, drop_primary_id: bool = True) -> DataFrame:
        """A table with nested fields as dotted columns; a column `{table}Id` identifies the rows
        and is not one of the audited columns."""
        flat = V.flatten_struct(self.stored(session_id, table))
        return flat.drop(f"{table}Id") if drop_primary_id else flat

    def tables(self, session_id: str, drop_primary_id: bool = True) -> dict[str, DataFrame]:
        return {n: self.table(session_id, n, drop_primary_id) for n in self.names(session_id)}

    def column(self, session_id: str, table: str, column: str) -> DataFrame:
        return self.table(session_id, table).select(V.col(column))

    def page(self, session_id: str, table: str, order: list[str], page: int = 1, page_size: int = 10) -> DataFrame:
        return paginate(self.stored(session_id, table), order, page, page_size)

    def page_info(self, session_id: str, table: str, page: int = 1, page_size: int = 10) -> DataFrame:
        """One row about a page: `(session_id, table_name, status, total_records, page, page_size,
        total_pages)`; an absent or expired table has no records."""
        if page < 1 or page_size < 1:
            raise ValueError("page and page_size must be at least 1")
        if table in self.names(session_id):
            counted = self.stored(session_id, table).agg(F.count("*").alias("total_records"))
            expires = self.spark.read.parquet(self._expiry(session_id, table)).agg(F.max(_EXPIRES)).scalar()
            alive = expires > F.current_timestamp()
        else:
            counted = self.spark.range(1).select(F.lit(0).cast("long").alias("total_records"))
            alive = F.lit(False)
        status = F.when(alive, "success").otherwise("expired_or_not_found")
        return counted.select(
            F.lit(session_id).alias("session_id"),
            F.lit(table).alias("table_name"),
            status.alias("status"),
            "total_records",
            F.lit(page).alias("page"),
            F.lit(page_size).alias("page_size"),
            F.ceil(F.col("total_records") / page_size).alias("total_pages"),
        )
