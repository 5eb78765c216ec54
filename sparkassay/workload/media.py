"""Image, box and vector queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import media, vectors
from sparkassay.workload.tables import rounded, scalar_sql, table

SIDE = 8


def aspect_ratio_variance(spark, folder):
    sizes = table(spark, folder, "part").select(F.col("p_size").alias("w"), (F.col("p_partkey") % 5).alias("h"))
    return rounded(media.aspect_ratio_variance(sizes))


def _images(spark, folder):
    """The embeddings as 8 x 8 gray images with levels 0 to 255."""

    def level(x):
        return F.floor((F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1) * 127.5)

    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", level).alias("pixels"))


def blur_index(spark, folder):
    return rounded(media.blur_index(_images(spark, folder), "pixels", SIDE).select("vec_id", "blur_index"), "blur_index")


def blur_index_of_pixels(spark, folder):
    pixels = _images(spark, folder).select(F.col("vec_id").alias("image_id"), F.posexplode("pixels").alias("i", "v"))
    rows = pixels.select("image_id", F.floor(F.col("i") / SIDE).alias("r"), (F.col("i") % SIDE).alias("c"), "v")
    return rounded(media.blur_index_of_pixels(rows), "blur_index")


def blur_index_colour(spark, folder):
    """Images of seven by three pixels in blue, green and red."""
    images = _images(spark, folder).select("vec_id", F.slice("pixels", 1, 63).alias("pixels"))
    return rounded(media.blur_index(images, "pixels", 3, channels=3).select("vec_id", "blur_index"), "blur_index")


def blur_index_of_colour_pixels(spark, folder):
    """The same as pixel rows, over tiles of two by two."""
    images = _images(spark, folder).select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "pixels")
    levels = [F.get("pixels", F.col("i") * 3 + k).alias(c) for k, c in enumerate(("b", "g", "red"))]
    rows = images.select("image_id", F.floor(F.col("i") / 3).alias("r"), (F.col("i") % 3).alias("c"), *levels)
    return rounded(media.blur_index_of_pixels(media.gray_pixels(rows), tile=2), "blur_index")


def iou_joined(spark, folder):
    """Boxes of orders from two tables: some stand on one side only, some have three or five numbers."""
    x, y, n = F.col("o_custkey") % 40, F.col("o_orderkey") % 30, F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    predicted = orders.where(n % 7 > 0).select(
        "o_orderkey", F.when(n % 11 == 0, F.array(x, y, x + 3)).otherwise(F.array(x, y, x + 10, y + 10)).cast("array<double>").alias("box")
    )
    true = orders.where(n % 5 > 0).select(
        "o_orderkey", F.when(n % 13 == 0, F.array(x, y, x, y, x)).otherwise(F.array(x + n % 4, y + n % 3, x + 12, y + 9)).cast("array<double>").alias("box")
    )
    return rounded(media.iou_joined(predicted, true, ["o_orderkey"]), "iou")


def iou_pairs(spark, folder):
    """Two boxes from the measures of every line item."""
    x, y = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    pairs = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        x.alias("ax1"), y.alias("ay1"), (x + F.col("l_quantity")).alias("ax2"), (y + F.col("l_linenumber") * 3).alias("ay2"),
        (x + 5).alias("bx1"), (y + F.col("l_linenumber") - 4).alias("by1"),
        (x + 5 + F.col("l_tax") * 400).alias("bx2"), (y + 10).alias("by2"),
    )
    boxes = media.intersection_over_union(pairs, ["ax1", "ay1", "ax2", "ay2"], ["bx1", "by1", "bx2", "by2"])
    return rounded(boxes.select("l_orderkey", "l_linenumber", "l_partkey", "iou"), "iou")


def _points(spark, folder):
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vector")


def _query(spark, folder, vec_id):
    return table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").scalar()


def vector_topk_cosine(spark, folder):
    points = _points(spark, folder)
    return rounded(vectors.search(points, _query(spark, folder, 7), 10), "score")


def vector_topk_dot(spark, folder):
    points = _points(spark, folder)
    return rounded(vectors.search(points, _query(spark, folder, 11), 10, distance="dot"), "score")


def vector_topk_filtered(spark, folder):
    points = _points(spark, folder)
    return rounded(vectors.search(points, _query(spark, folder, 3), where=F.col("label").isin(2, 5)), "score")


def vector_upsert(spark, folder):
    """Every third point is written anew, every ninth twice, and new points are added."""
    points = _points(spark, folder)
    again = points.where("id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("at", F.lit(1))
    twice = points.where("id % 9 = 0").withColumn("label", F.col("label") + 200).withColumn("at", F.lit(2))
    added = points.where("id % 10 = 1").withColumn("id", F.col("id") + 1000000000).withColumn("at", F.lit(1))
    batch = twice.unionByName(again).unionByName(added)
    written = vectors.upsert(points, batch, order_column="at")
    return written.select("id", "label", F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


QUERIES = {
    "aspect_ratio_variance": aspect_ratio_variance,
    "blur_index": blur_index,
    "blur_index_of_pixels": blur_index_of_pixels,
    "blur_index_colour": blur_index_colour,
    "blur_index_of_colour_pixels": blur_index_of_colour_pixels,
    "iou_joined": iou_joined,
    "iou_pairs": iou_pairs,
    "vector_topk_cosine": vector_topk_cosine,
    "vector_topk_dot": vector_topk_dot,
    "vector_topk_filtered": vector_topk_filtered,
    "vector_upsert": vector_upsert,
}

_PIXELS = """
    p AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c,
                 floor((least(greatest(CAST(embedding[i] AS DOUBLE), -1.0), 1.0) + 1) * 127.5) AS v
          FROM embeddings, generate_series(1, 64) AS t(i))"""


_COLOURS = """
    l AS (SELECT vec_id, i - 1 AS i, floor((least(greatest(CAST(embedding[i] AS DOUBLE), -1.0), 1.0) + 1) * 127.5) AS x
          FROM embeddings, generate_series(1, 63) AS t(i)),
    p AS (SELECT vec_id, i // 9 AS r, i // 3 % 3 AS c,
                 round(CAST(sum(CASE WHEN i % 3 = 0 THEN x END) AS DOUBLE) * 0.114::DOUBLE
                       + CAST(sum(CASE WHEN i % 3 = 1 THEN x END) AS DOUBLE) * 0.587::DOUBLE
                       + CAST(sum(CASE WHEN i % 3 = 2 THEN x END) AS DOUBLE) * 0.299::DOUBLE) AS v FROM l GROUP BY vec_id, i // 9, i // 3 % 3)"""


def _blur(key: str, pixels: str = _PIXELS, height: int = 8, width: int = 8) -> str:
    """Each pixel with its four neighbours, mirrored at the border."""

    def mirrored(side: str, step: int) -> str:
        last = (height if side == "r" else width) - 1
        edge = 0 if step < 0 else last
        inner = 1 if step < 0 else last - 1
        return f"CASE WHEN a.{side} = {edge} THEN {inner} ELSE a.{side} + ({step}) END"

    return f"""
        WITH {pixels},
        lap AS (SELECT a.vec_id, u.v + d.v + l.v + r.v - 4 * a.v AS x FROM p a
                JOIN p u ON u.vec_id = a.vec_id AND u.c = a.c AND u.r = {mirrored("r", -1)}
                JOIN p d ON d.vec_id = a.vec_id AND d.c = a.c AND d.r = {mirrored("r", 1)}
                JOIN p l ON l.vec_id = a.vec_id AND l.r = a.r AND l.c = {mirrored("c", -1)}
                JOIN p r ON r.vec_id = a.vec_id AND r.r = a.r AND r.c = {mirrored("c", 1)})
        SELECT vec_id AS {key}, round(var_pop(x), 6) AS blur_index FROM lap GROUP BY vec_id"""


def _topk(score: str, query: int, k: int, where: str = "true") -> str:
    return f"""
        SELECT vec_id AS id, round({score}, 6) AS score, label
        FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a,
                     (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {query}) AS b
              FROM embeddings WHERE {where})
        ORDER BY {score} DESC, vec_id LIMIT {k}"""


ORACLE = {
    "aspect_ratio_variance": scalar_sql(
        "aspect_ratio_variance",
        "var_pop(CASE WHEN p_partkey % 5 > 0 THEN p_size / (p_partkey % 5) END)",
        "part",
    ),
    "blur_index": _blur("vec_id"),
    "blur_index_of_pixels": _blur("image_id"),
    "blur_index_colour": _blur("vec_id", _COLOURS, 7, 3),
    "blur_index_of_colour_pixels": _blur("image_id", _COLOURS, 7, 3),
    "iou_joined": """
        WITH o AS (SELECT o_orderkey AS k, o_custkey % 40 AS x, o_orderkey % 30 AS y FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey % 5 > 0),
             w AS (SELECT k, k % 7 > 0 AND k % 11 > 0 AND k % 5 > 0 AND k % 13 > 0 AS whole,
                          least(x + 10, x + 12) - greatest(x, x + k % 4) AS w, least(y + 10, y + 9) - greatest(y, y + k % 3) AS h,
                          100 + (12 - k % 4) * (9 - k % 3) AS areas FROM o)
        SELECT k AS o_orderkey, round(CASE WHEN whole THEN w * h / (areas - w * h) ELSE 0 END, 6) AS iou FROM w""",
    "iou_pairs": """
        WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 40 AS x, l_partkey % 40 AS y,
                          l_quantity AS q, l_linenumber AS n, l_tax * 400 AS t FROM lineitem),
             s AS (SELECT *, least(x + q, x + 5 + t) - greatest(x, x + 5) AS w,
                          least(y + n * 3, y + 10) - greatest(y, y + n - 4) AS h FROM b),
             j AS (SELECT *, q * (n * 3) + t * (14 - n) - w * h AS joint FROM s)
        SELECT l_orderkey, l_linenumber, l_partkey,
               round(CASE WHEN w < 0 OR h < 0 OR joint <= 0 THEN 0 ELSE w * h / joint END, 6) AS iou FROM j""",
    "vector_topk_cosine": _topk("list_cosine_similarity(a, b)", 7, 10),
    "vector_topk_dot": _topk("list_inner_product(a, b)", 11, 10),
    "vector_topk_filtered": _topk("list_cosine_similarity(a, b)", 3, 3, "label IN (2, 5)"),
    "vector_upsert": """
        WITH w AS (SELECT vec_id AS id, label, embedding, 0 AS place FROM embeddings
                   UNION ALL SELECT vec_id, label + 100, embedding, 1 FROM embeddings WHERE vec_id % 3 = 0
                   UNION ALL SELECT vec_id, label + 200, embedding, 2 FROM embeddings WHERE vec_id % 9 = 0
                   UNION ALL SELECT vec_id + 1000000000, label, embedding, 1 FROM embeddings WHERE vec_id % 10 = 1)
        SELECT id, label, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS rn FROM w) WHERE rn = 1""",
}
