"""The pipeline's stages keep what they should, on the given tables and on awkward ones."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_row", F.lit("clash")).withColumn("contaminated", F.lit(1))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    pieces = corpus_pipeline.packed(spark, docs, folder)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.dropDuplicates(["doc_id", "doc_tokens"]).agg(F.sum("doc_tokens")).first()[0]
