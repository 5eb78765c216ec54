"""Change points in series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.operators.ranks import WINDOW_ROWS, group_sizes, with_positions

# Points whose moments one window task gathers; a chunk of a longer series has several such pieces.
PIECE = 250_000

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def merged(a: Column, b: Column) -> Column:
    """Moments (n, mean, m2) of two sets of points together; m2 is the sum of squares around the mean.
    Nothing is ever subtracted out again, so a spike only touches the windows that hold it."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + gap * (b["n"] / n)).alias("mean"),
        (a["m2"] + b["m2"] + gap * gap * (a["n"] * b["n"] / n)).alias("m2"),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def change_point_scores(
    df: DataFrame, keys: Sequence[str], order: str, column: str, window_rows: int = WINDOW_ROWS, piece: int = PIECE
) -> DataFrame:
    """Per series `(keys, points, value)`: share of the points strictly outside the centred rolling
    mean by more than two sample standard deviations.

    A series of n points uses a window of w = max(2, n div 5), needs the whole window present, and
    scores 0 below three points. The order must be unique within a series.

    A series is cut every w points. Each window is then the end of one chunk and the start of the
    next, and its moments are those of the two, merged. The moments of all starts and ends are growing
    windows over pieces of bounded length; pieces of a chunk are merged in order where there are several.
    Start, end and centre of a window lie apart: every point sends what it has to the centres it belongs to, and
    the three meet in one aggregation by (series, index). No task holds a long series (`window_rows` and
    `piece` only choose the plan: positions are exact and merging is the same at every size).
    """
    keys = list(keys)
    rows = df.select(*(V.col(k) for k in keys), V.col(order).alias("_t"), V.number(df, column).alias("_v"))
    longest, _ = group_sizes(rows, keys)
    numbered = with_positions(rows, ["_t"], keys, position="_i", size="_n", window_rows=window_rows, sizes=(longest, None))
    w = F.greatest(F.lit(2), F.floor(F.col("_n") / 5))
    placed = numbered.select(
        *keys, "_n", "_i", "_v", F.floor(F.col("_i") / w).alias("_chunk"), F.floor(F.col("_i") % w / piece).alias("_piece")
    )
    moments = _piecewise(placed, keys)
    if longest // 5 > piece:
        moments = _across_pieces(moments, keys)

    ahead = F.floor((w - 1) / 2)  # points of the window after its centre
    behind = w - 1 - ahead
    none = F.lit(None).cast("double")

    def sends(at: Column, value: Column, head: Column | None, tail: Column | None) -> Column:
        """A row for a centre; plain numbers, so that the rows of a centre meet in a hash aggregation."""
        parts = [(side[f].cast("double") if side is not None else none).alias(name + f) for name, side in (("head_", head), ("tail_", tail)) for f in _FIELDS]
        return F.struct(at.alias("at"), value.alias("v"), *parts)

    # the last point of a window brings the start of its chunk, the first one the end of its own
    here = sends(F.col("_i"), F.col("_v"), None, None)
    ends = sends(F.col("_i") - ahead, none, F.col("_head"), None)
    begins = sends(F.col("_i") + behind, none, None, F.col("_tail"))
    sent = moments.select(*keys, "_n", F.inline(F.array(here, ends, begins))).where(
        (F.col("at") >= 0) & (F.col("at") < F.col("_n"))
    )
    names = ["v", *(f"{side}_{f}" for side in ("head", "tail") for f in _FIELDS)]
    met = sent.groupBy(*keys, "_n", "at").agg(*(F.max(c).alias(c) for c in names))
    head, tail = (F.struct(*(F.col(f"{side}_{f}").alias(f) for f in _FIELDS)) for side in ("head", "tail"))
    # a window that begins with a chunk is that chunk: its end is all of it
    whole = (F.col("at") - behind) % w == 0
    judged = met.withColumn("_w", F.when(whole, tail).otherwise(merged(tail, head)))
    spread = F.sqrt(F.col("_w.m2") / (w - 1))
    distance = F.abs(F.col("v") - F.col("_w.mean"))
    outside = (F.col("_w.n") == w) & (distance > spread * 2) & ~F.isnan(distance)
    score = F.when(F.coalesce(F.max("_n"), F.lit(0)) < 3, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.count_if(outside) / F.max("_n"))
    )
    return judged.groupBy(*keys).agg(F.max("_n").alias("points"), score.alias("value"))


_FIELDS = ("n", "mean", "m2")
_MOMENTS = "struct<n:bigint,mean:double,m2:double>"


def _piecewise(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Per point the moments of its piece up to it (`_head`) and from it on (`_tail`). Values are taken from the first
    one of the piece, so that equal ones leave no rounding."""
    one = Window.partitionBy(*keys, "_chunk", "_piece")
    origin = F.first("_v", ignorenulls=True).over(one.orderBy("_i").rowsBetween(_START, _END))
    shifted = placed.withColumn("_origin", F.coalesce(origin, F.lit(0.0))).withColumn("_d", F.col("_v") - F.col("_origin"))

    def upto(order: Column) -> Column:
        frame = one.orderBy(order).rowsBetween(_START, Window.currentRow)
        n = F.count("_d").over(frame)
        mean = F.col("_origin") + F.coalesce(F.avg("_d").over(frame), F.lit(0.0))
        return F.struct(n.alias("n"), mean.alias("mean"), (F.coalesce(F.var_pop("_d").over(frame), F.lit(0.0)) * n).alias("m2"))

    return shifted.withColumn("_head", upto(F.col("_i").asc())).withColumn("_tail", upto(F.col("_i").desc()))


def _across_pieces(moments: DataFrame, keys: list[str]) -> DataFrame:
    """The moments widened to the whole chunk: pieces before are merged into `_head`, pieces behind into `_tail`. Per
    chunk one short list of pieces is folded, in both directions."""
    of_chunk = [*keys, "_chunk"]
    pieces = moments.groupBy(*of_chunk, "_piece").agg(F.max_by("_head", "_i").alias("m"))
    lists = pieces.groupBy(*of_chunk).agg(F.sort_array(F.collect_list(F.struct("_piece", "m"))).alias("ps"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    seed = F.array(zero).cast(f"array<{_MOMENTS}>")

    def folded(ps: Column, ahead: bool) -> Column:
        """Moments before every piece, starting with none."""
        def step(acc: Column, p: Column) -> Column:
            last = F.element_at(acc, -1)
            both = merged(last, p["m"]) if ahead else merged(p["m"], last)
            return F.concat(acc, F.array(both.cast(_MOMENTS)))

        return F.aggregate(ps, seed, step)

    around = lists.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(of_chunk)),
        F.posexplode(F.arrays_zip(
            F.slice(folded(F.col("ps"), True), F.lit(1), F.size("ps")).alias("before"),
            F.reverse(F.slice(folded(F.reverse("ps"), False), F.lit(1), F.size("ps"))).alias("behind"),
        )).alias("_p", "_around"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(of_chunk)]
    met = moments.join(around, [*same, F.col("_piece") == F.col("_p")])
    head, tail = F.col("_head"), F.col("_tail")
    return met.select(
        *keys, "_n", "_i", "_v", merged(F.col("_around.before"), head).alias("_head"), merged(tail, F.col("_around.behind")).alias("_tail")
    )


def change_point_detection_score(
    df: DataFrame, order: str, column: str, window_rows: int = WINDOW_ROWS, piece: int = PIECE
) -> DataFrame:
    """The score of a table that is one series; 0 for an empty one."""
    scores = change_point_scores(df, [], order, column, window_rows, piece)
    return scores.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value")).select(
        F.lit("change_point_detection_score").alias("metric"), "value"
    )
