"""Small helpers that the operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.operators.ranks import new_folder

# What stands between words of the contracts' first kind, and words of the second; fixed values.
BETWEEN_ASCII_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hash values are cut into so many steps where a share of the rows is taken.
STEPS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Ids of eight bytes that may be broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


#: Spark's setting by which shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes that go to a task's Python side at once; else only rows are counted, 10,000 of any length.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def settled(df: DataFrame, purpose: str, batch_bytes: int | None = None) -> DataFrame:
    """The table written to the shared folder and read back. Its own shuffle files go when it is written, others as soon
    as the driver collects its garbage, so it is asked to: disks then hold about one step's shuffles."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, purpose)
    wanted = {SHUFFLES_GO: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def release(table: DataFrame) -> None:
    """Remove a settled table that nothing will read again."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.settled_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame) -> DataFrame:
    """A settled table of ids, to be broadcast where its count proves it small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def share(doc_id: Column, wanted: int, there: int, seed: int = 0) -> Column:
    """True for about `wanted` of `there` rows, chosen by a hash of the id."""
    if there <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(STEPS)) < max(1, wanted * STEPS // there)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _hash): what names a document. Rows that repeat id and text are one document.
    Only these columns are read, so others may have any name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("_text"), F.xxhash64(F.col("text")).alias("_hash"))

