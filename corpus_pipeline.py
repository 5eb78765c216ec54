"""From raw documents to packed sequences: five stages, each one operator.

A stage works on all that the one before kept. Rows with equal ids and texts are treated alike; rows
without id pass the stages that would have to name them. NULL texts count as empty. Tables may be
empty, and may have further columns, which travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import decontamination, jaccard, packing, quality_pu, substrings
from sparkassay.llm.common import table
from sparkassay.llm.queries import tokenizer_path
from sparkassay.operators.ranks import new_folder


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_pu.quality_score(F.col("text"), model) >= 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays."""
    groups = jaccard.jaccard_components(docs).where("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["_gone"], "left_anti")


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one column beside id and text, so that no further column can clash with a working name."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out; n_chars follows the text."""
    documents = _whole(docs).withColumn("_hash", F.xxhash64("text"))
    found = substrings.repeats(substrings.keyed(docs))
    joined = documents.join(found, F.expr("doc_id <=> _id AND _hash = _mark"), "left")
    cut = joined.select("_row", substrings.cut_out(F.col("text"), F.col("_places")).alias("_r"))
    shorter = F.when(F.col("_r.n_removed") > 0, F.length("_r.text")).otherwise(F.col("_row.n_chars"))
    fixed = {"text": F.col("_r.text"), "n_chars": shorter.cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(fixed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    marked = decontamination.decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), carry=["_row"])
    return marked.where("NOT contaminated").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
# A network, chunk hashes and a tokeniser are not SQL; tests/llm checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
