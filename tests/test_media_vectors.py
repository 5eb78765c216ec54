"""Images, boxes and vectors on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.functions.boxes import box_from_array, gray, iou
from sparkassay.operators import media, vectors


def laplacian_variance(image):
    p = np.pad(image.astype(float), [(1, 1) if n > 1 else (0, 0) for n in image.shape], mode="reflect")
    for axis, n in enumerate(image.shape):
        if n == 1:
            p = np.concatenate([p, p, p], axis=axis)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


@pytest.mark.parametrize("shape", [(8, 8), (5, 3), (1, 7), (7, 1), (2, 2), (1, 1), (40, 25)])
def test_blur_against_a_padded_stencil(spark, shape):
    image = np.random.default_rng(sum(shape)).integers(0, 256, size=shape)
    whole = spark.createDataFrame([(1, [int(x) for x in image.ravel()])], "image_id bigint, px array<int>")
    pixels = spark.createDataFrame(
        [(1, int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(image)], "image_id bigint, r int, c int, v double"
    )
    expected = pytest.approx(laplacian_variance(image))
    assert media.blur_index(whole, "px", shape[1]).first()["blur_index"] == expected
    assert media.blur_index_of_pixels(pixels).first()["blur_index"] == expected


@pytest.mark.parametrize("shape", [(40, 25), (1, 30), (16, 16), (9, 8)])
def test_blur_over_tiles(spark, shape):
    image = np.random.default_rng(3).integers(0, 256, size=shape)
    rows = [(1, int(r) - 4, int(c) - 4, float(v)) for (r, c), v in np.ndenumerate(image)]
    pixels = spark.createDataFrame(rows, "image_id bigint, r int, c int, v double").repartition(3)
    for tile in (1, 3, 8, 256):
        assert media.blur_index_of_pixels(pixels, tile).first()["blur_index"] == pytest.approx(laplacian_variance(image))
    plan = media.blur_index_of_pixels(pixels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 2  # by tile, and one row a task and image


def test_blur_of_colours(spark):
    image = np.random.default_rng(5).integers(0, 256, size=(6, 5, 3))
    gray_image = np.floor(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299 + 0.5)
    whole = spark.createDataFrame([([int(x) for x in image.ravel()],), ([1, 2],), (None,)], "px array<int>")
    got = [r["blur_index"] for r in media.blur_index(whole, "px", 5, channels=3).collect()]
    assert got == [pytest.approx(laplacian_variance(gray_image)), 0.0, 0.0]
    with pytest.raises(ValueError, match="channel"):
        media.blur_index(whole, "px", 5, channels=2)


def test_joined_boxes(spark):
    a = spark.createDataFrame([(1, [0, 0, 2, 2]), (2, [0, 0, 2]), (3, None), (4, [0, 0, 1, None]), (5, [0, 0, 4, 4])], "image int, box array<int>")
    b = spark.createDataFrame([(1, [1, 0, 3, 2]), (2, [0, 0, 2, 2]), (4, [0, 0, 1, 1]), (6, [0, 0, 1, 1])], "image int, box array<int>")
    got = {r["image"]: r["iou"] for r in media.iou_joined(a, b, ["image"]).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_blur_of_flat_and_missing_images(spark):
    t = spark.createDataFrame([(1, [7] * 12), (2, []), (3, None)], "image_id bigint, px array<int>")
    assert [r["blur_index"] for r in media.blur_index(t, "px", 4).orderBy("image_id").collect()] == [0.0, 0.0, 0.0]


def test_gray(spark):
    assert spark.range(1).select(gray(F.lit(10.0), F.lit(20.0), F.lit(30.0))).first()[0] == 22.0


def test_boxes(spark):
    pairs = [
        ([0, 0, 2, 2], [0, 0, 2, 2], 1.0), ([0, 0, 4, 4], [1, 1, 3, 3], 0.25), ([0, 0, 1, 1], [1, 0, 2, 1], 0.0),
        ([0, 0, 1, 1], [5, 5, 6, 6], 0.0), ([0, 0, 0, 0], [0, 0, 0, 0], 0.0), ([0, 0, 2, 2], [1, 0, 3, 2], 1 / 3),
        ([0, 0, 2], [0, 0, 2, 2], 0.0),
    ]
    t = spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a array<int>, b array<int>, wanted double")
    a, b = box_from_array(F.col("a")), box_from_array(F.col("b"))
    for row in t.select(iou(a, b).alias("ab"), iou(b, a).alias("ba"), "wanted").collect():
        assert row["ab"] == pytest.approx(row["wanted"]) == row["ba"]


def test_aspect_ratios(spark, value):
    t = spark.createDataFrame([(4, 2), (3, 3), (5, 0)], "w int, h int")
    assert value(media.aspect_ratio_variance(t)) == pytest.approx(0.25)
    assert value(media.aspect_ratio_variance(t.where("w = 4"))) == 0.0
    assert value(media.aspect_ratio_variance(t.where("h = 0").unionAll(t.where("h = 0")))) == 0.0
    assert value(media.aspect_ratio_variance(t.limit(0))) == 0.0


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [0.0, 0.0], "a"), (4, [3.0, 3.0], "b"), (5, [2.0, 0.0], "a")]
    return spark.createDataFrame(rows, "id bigint, vector array<float>, payload string")


def test_search(points):
    def ids(*args, **options):
        return [r["id"] for r in vectors.search(points, *args, **options).collect()]

    assert ids([1.0, 0.0]) == [1, 5, 4]
    assert ids([1.0, 0.0], 2, "dot") == [4, 5]
    assert ids([1.0, 0.0], 2, "unheard of") == [1, 5]
    assert ids([1.0, 0.0], 9, where=F.col("payload") == "b") == [4, 2]
    assert vectors.search(points, [1.0, 0.0]).columns == ["id", "score", "payload"]
    assert vectors.search(points, [0.0, 0.0]).first()["score"] == 0.0


def test_upsert_keeps_the_last_write(points, spark):
    batch = spark.createDataFrame(
        [(2, [9.0], "new", 1), (2, [8.0], "newer", 2), (7, [1.0], "added", 1)],
        "id bigint, vector array<float>, payload string, at int",
    )
    got = {r["id"]: r["payload"] for r in vectors.upsert(points, batch, order_column="at").collect()}
    assert got == {1: "a", 2: "newer", 3: "a", 4: "b", 5: "a", 7: "added"}
    assert vectors.upsert(points, batch.where("at = 1")).count() == 6
