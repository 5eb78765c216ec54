"""Box and pixel expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(box1: Sequence[Column], box2: Sequence[Column]) -> Column:
    """Overlap area over joint area of two boxes given as (x1, y1, x2, y2)."""
    ax1, ay1, ax2, ay2 = (c.cast("double") for c in box1)
    bx1, by1, bx2, by2 = (c.cast("double") for c in box2)
    width = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    height = F.least(ay2, by2) - F.greatest(ay1, by1)
    shared = width * height
    joint = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - shared
    return F.when((width < 0) | (height < 0) | (joint <= 0), F.lit(0.0)).otherwise(
        shared / F.when(joint > 0, joint)
    )


def box_from_array(box: Column) -> list[Column]:
    """The four corners of a box held in an array; zeros when it does not have four numbers."""
    whole = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    return [F.when(whole, F.get(box, i)).otherwise(F.lit(0.0)) for i in range(4)]


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Gray level of a colour pixel, rounded to a whole number."""
    return F.round(blue * 0.114 + green * 0.587 + red * 0.299)


def gray_levels(pixels: Column) -> Column:
    """Gray levels of an image whose array has blue, green and red level of every pixel, one after the other."""
    places = F.when(F.size(pixels) >= 3, F.sequence(F.lit(0), (F.size(pixels) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: gray(F.get(pixels, i * 3), F.get(pixels, i * 3 + 1), F.get(pixels, i * 3 + 2)))


def sharpness(pixels: Column, width: int) -> Column:
    """Population variance of the Laplacian of an image held row by row in one array.

    Everything stays inside the row: no explode, no shuffle. At the border the picture is mirrored
    without repeating the edge; along a side of length one the pixel is its own neighbour.
    """
    n = F.size(pixels)
    w = F.lit(width)

    def beside(index: Column, step: Column, first: Column, last: Column) -> tuple[Column, Column]:
        single = first & last
        before = F.when(single, index).when(first, index + step).otherwise(index - step)
        after = F.when(single, index).when(last, index - step).otherwise(index + step)
        return before, after

    def laplacian(v: Column, i: Column) -> Column:
        column_no = F.pmod(i, w)
        left, right = beside(i, F.lit(1), column_no == 0, column_no == w - 1)
        up, down = beside(i, w, i < w, i >= n - w)
        return (
            F.get(pixels, left) + F.get(pixels, right) + F.get(pixels, up) + F.get(pixels, down) - v * 4
        ).cast("double")

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(
        F.transform(pixels, laplacian),
        zero,
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
        lambda acc: F.greatest(F.lit(0.0), F.try_divide(acc["q"] - F.try_divide(acc["s"] * acc["s"], n), n)),
    )
    return F.coalesce(F.when(n > 0, sums), F.lit(0.0))
