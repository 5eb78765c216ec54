"""Vector search and upsert over tables of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import values as V


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def search(
    points: DataFrame,
    query: Column | Sequence[float],
    top_k: int = 3,
    distance: str = "cosine",
    where: Column | None = None,
    id_column: str = "id",
    vector_column: str = "vector",
) -> DataFrame:
    """The `top_k` points nearest to the query, as `(id, score, payload columns…)`, best first.

    `query` is a list of numbers or a scalar subquery. Unknown distances mean cosine. Only the k
    best rows of each task leave it; equal scores go by id.
    """
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    found = (points if where is None else points.where(where)).withColumn("_query", q)
    vector, q = V.col(vector_column), F.col("_query")
    score = dot(vector, q) if distance == "dot" else cosine(vector, q)
    payload = [V.col(c) for c in points.columns if c not in (id_column, vector_column)]
    scored = found.select(V.col(id_column), score.alias("score"), *payload)
    return scored.orderBy(F.desc("score"), F.asc(id_column)).limit(top_k)


def _last_write(last: Column, order_column: str | None) -> Column:
    if order_column:
        return last
    unordered = F.raise_error(F.lit("an id is written twice and no order_column says which write is the last"))
    return F.when(F.count("*") > 1, unordered.cast("void")).otherwise(last)


def upsert(points: DataFrame, batch: DataFrame, id_column: str = "id", order_column: str | None = None) -> DataFrame:
    """Points with the batch written over them: per id the last write wins, within the batch by
    `order_column`; without one, an id may stand in the batch only once. Stored points have one row per id.

    Stored points only lose the ids that are written anew; a small batch leaves them where they
    are. Writes of one id are reduced to the last before they are shuffled.
    """
    columns = points.columns
    payload = [c for c in columns if c != id_column]
    order = V.col(order_column) if order_column else F.lit(0)
    last = (
        batch.groupBy(V.col(id_column))
        .agg(_last_write(F.max_by(F.struct(*(V.col(c) for c in payload)), order), order_column).alias("_last"))
        .select(*(V.col(id_column) if c == id_column else F.col("_last").getField(c).alias(c) for c in columns))
    )
    kept = points.join(batch.select(V.col(id_column)).distinct(), id_column, "left_anti").select(*columns)
    return kept.unionByName(last)
