"""The registered queries of the operators, and the SQL that answers the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import (
    decontamination,
    extraction,
    jaccard,
    language,
    licenses,
    packing,
    periodic,
    quality_pu,
    repetition,
    substrings,
    toxicity,
    warc,
    whitening,
)
from sparkassay.llm.common import fold, table

#: Words of a shingle and similarity that the contract of op5 fixes.
CONTRACT_WORDS, CONTRACT_SIMILARITY = 4, (85, 100)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return marked.drop("hits")


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"), CONTRACT_WORDS, CONTRACT_SIMILARITY)


def _held(folds: int, held: int):
    return F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs)
    rows = docs.select("doc_id", _held(3, 1), language.language(F.col("text"), model).alias("_r"))
    return rows.select("doc_id", "held_out", "_r.lang_pred", "_r.score", F.size("_r.spans").cast("long").alias("n_spans"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", _held(5, 0), toxicity.toxicity(F.col("text"), model).alias("_r"))
    return rows.select("doc_id", "held_out", "_r.score", "_r.predicted", "_r.neighbours", "_r.evidence")


def op9_quality_pu(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_pu.fit(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", _held(3, 1), quality_pu.quality_score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality_rules(table(spark, folder, "documents"))


def op11_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    texts = docs.select("doc_id", periodic.rewritten(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.find_runs(texts))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_license_scan,
        op3_packing,
        op4_decontamination,
        op5_jaccard_join,
        op6_language_id,
        op7_html_extraction,
        op8_toxicity,
        op9_quality_pu,
        op10_quality_rules,
        op11_warc_salvage,
        op12_periodic_runs,
        op13_whitening,
    )
}
# Twenty bytes are eight groups of five hexadecimal digits, and each of these four digits of base 32.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(key, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '')"""

# The others are not plain SQL: each adds what its own method finds (labels, proximity, verdicts, scores,
# places). tests/llm holds them against brute-force versions of their contracts.
ORACLE: dict[str, str] = {
    "op11_warc_salvage": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS key FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY key) AS first FROM p)
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
}
