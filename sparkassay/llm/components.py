"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import settled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link, but for the smallest nodes
    themselves. `links` has columns u and v. Every round is written to the shared folder, so lineage stays short; only a
    checksum of each round comes to the driver. Hot nodes are joined, never gathered."""
    edges = settled(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(hung.where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
