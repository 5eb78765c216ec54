"""Image and box metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions import boxes as B
from sparkassay.functions import values as V
from sparkassay.operators.quality import metric_row


def aspect_ratio_of(df: DataFrame, width: str, height: str) -> Column:
    w, h = V.number(df, width), V.number(df, height)
    # The row count is taken before, the heights are filtered after.
    return F.when(F.count("*") < 2, F.lit(0.0)).otherwise(
        F.coalesce(F.var_pop(F.when(h > 0, w / F.when(h > 0, h))), F.lit(0.0))
    )


def aspect_ratio_variance(df: DataFrame, width: str = "w", height: str = "h") -> DataFrame:
    """Population variance of width / height over the images with a positive height."""
    return metric_row(df, "aspect_ratio_variance", aspect_ratio_of(df, width, height))


def blur_index(images: DataFrame, pixels: str, width: int, channels: int = 1) -> DataFrame:
    """Blur index of images held as one array each (row by row), as column `blur_index`; low means
    blurred. With three channels a pixel is its blue, green and red level, one after the other, and the gray levels
    count. Computed inside the row."""
    if channels not in (1, 3):
        raise ValueError("an image has one channel or three")
    levels = V.col(pixels) if channels == 1 else B.gray_levels(V.col(pixels))
    return images.withColumn("blur_index", F.coalesce(B.sharpness(levels, width), F.lit(0.0)))


#: Side of the tiles that pixels are dealt to.
TILE = 256


def gray_pixels(pixels: DataFrame, blue: str = "b", green: str = "g", red: str = "red") -> DataFrame:
    """Colour pixel rows `(image_id, r, c, blue, green, red)` as gray ones `(image_id, r, c, v)`."""
    return pixels.select("image_id", "r", "c", B.gray(V.col(blue), V.col(green), V.col(red)).alias("v"))


def blur_index_of_pixels(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Blur index of images held as pixel rows `(image_id, r, c, v)`, one a pixel: rows `(image_id, blur_index)`.

    Pixels are dealt to square tiles; those at a tile's side go to the tile beside it too, so every tile has all
    neighbours of its pixels, for a few rows more than there are pixels. One shuffle by tile; an image of any
    size spreads over all tasks. At the border of the image the opposite neighbour stands in.
    """
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    tr, tc = F.floor(r / tile), F.floor(c / tile)

    def dealt(down: int, right: int, when: Column | None = None) -> Column:
        place = F.struct((tr + down).alias("tr"), (tc + right).alias("tc"), F.lit(when is None).alias("own"))
        return place if when is None else F.when(when, place)

    row, column = F.pmod(r, F.lit(tile)), F.pmod(c, F.lit(tile))
    places = F.array_compact(F.array(
        dealt(0, 0), dealt(-1, 0, row == 0), dealt(1, 0, row == tile - 1), dealt(0, -1, column == 0), dealt(0, 1, column == tile - 1)
    ))
    v = F.col("v").cast("double")
    sent = pixels.select("image_id", r.alias("r"), c.alias("c"), v.alias("v"), F.inline(places)).where("v IS NOT NULL")
    spread = sent.repartition("image_id", "tr", "tc")

    def beside(across: str, along: str, step: int) -> Column:
        # the tile line by line: the next row is the neighbour if it stands in the same line, one step on
        lines = Window.partitionBy("image_id", "tr", "tc").orderBy(across, along)
        next_ = (F.lag if step < 0 else F.lead)(F.struct(across, along, "v")).over(lines)
        return F.when((next_[across] == F.col(across)) & (next_[along] == F.col(along) + step), next_["v"])

    met = spread.select(
        "*", beside("r", "c", -1).alias("left"), beside("r", "c", 1).alias("right"), beside("c", "r", -1).alias("up"), beside("c", "r", 1).alias("down")
    ).where("own")
    laplacian = (
        F.coalesce("up", "down", "v") + F.coalesce("down", "up", "v") + F.coalesce("left", "right", "v") + F.coalesce("right", "left", "v")
        - F.col("v") * 4
    )
    return met.groupBy("image_id").agg(F.coalesce(F.var_pop(laplacian), F.lit(0.0)).alias("blur_index"))


def iou_joined(predicted: DataFrame, true: DataFrame, keys: Sequence[str], box: str = "box", name: str = "iou") -> DataFrame:
    """Overlap of the predicted and the true box of every key (image, or image and object): rows `(keys, iou)`.

    Boxes are arrays of four numbers. A malformed box counts as four zeros, and so does one that only the other
    side has: its overlap is 0. Keys name one box a side; where a side repeats a key, every pair of its boxes is answered."""
    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(*(V.col(k).alias(f"_{label}{i}") for i, k in enumerate(keys)), V.col(box).alias(f"_{label}"))

    met = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))]
    pairs = side(predicted, "a").join(side(true, "b"), met, "full_outer")
    both = [B.box_from_array(F.coalesce(F.col(c), F.array().cast("array<double>"))) for c in ("_a", "_b")]
    named = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    return pairs.select(*named, B.iou(*both).alias(name))


def intersection_over_union(
    pairs: DataFrame, box1: Sequence[str], box2: Sequence[str], name: str = "iou"
) -> DataFrame:
    """Overlap of the two boxes of every row, as a further column."""
    return pairs.withColumn(name, B.iou([V.col(c) for c in box1], [V.col(c) for c in box2]))
