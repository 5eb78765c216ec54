"""Exact ranks without a global sort in one task.

`order_statistics` selects exact quantiles of many columns in a few shared scans; `with_positions` numbers
the rows of every group along an order, also when one group holds a large share of all rows.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A sketch of this accuracy hands on so many evenly spaced values. Sketches are merged within this many
# groups of tasks, so that no task merges the sketches of all others and only a bounded list reaches the driver.
SKETCH_ACCURACY = 5_000
SKETCH_POINTS = 1_000
SKETCH_GROUPS = 64
# A bracket with at most so many rows is fetched, as distinct values with their counts.
FEW_ROWS = 20_000
# Groups up to this many rows are numbered by a plain window.
WINDOW_ROWS = 2_000_000
MOST_BLOCKS = 20_000
BLOCK, GROUP = "_block", "_group"


def linear_position(n: int, fraction: float) -> float:
    """Where a linearly interpolated quantile lies among n sorted values, counted from 0."""
    return (n - 1) * fraction


class Bracket(NamedTuple):
    """Rows of a column strictly between two values (None: no limit), after `before` rows."""

    column: int
    low: float | None
    high: float | None
    before: int
    inside: int

    def holds(self, v: Column) -> Column:
        above = F.lit(True) if self.low is None else v > F.lit(self.low)
        return above if self.high is None else above & (v < F.lit(self.high))


def _sketched(rows: DataFrame, cells: Sequence[Column], accuracy: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per cell: how many rows have a value, and values along the order with the share of rows up to each, roughly."""
    points = min(SKETCH_POINTS, max(10, accuracy // 5))
    # one text literal, not one literal per point, keeps the plan small
    spaced = F.split(F.lit(",".join(f"{i / points:.9f}" for i in range(points + 1))), ",").cast("array<double>")
    grouped = rows.select(
        F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"), *(c.alias(f"v{i}") for i, c in enumerate(cells))
    ).groupBy("g")
    names = range(len(cells))
    found = grouped.agg(
        *(F.count(f"v{i}").alias(f"n{i}") for i in names), *(F.percentile_approx(f"v{i}", spaced, accuracy).alias(f"p{i}") for i in names)
    ).collect()  # at most SKETCH_GROUPS rows
    out = []
    for i in names:
        parts = [(r[f"n{i}"], r[f"p{i}"]) for r in found if r[f"n{i}"]]
        if not parts:
            out.append((0, np.zeros(0), np.zeros(0)))
            continue
        values = np.concatenate([p for _, p in parts])
        weights = np.repeat([n / (points + 1) for n, _ in parts], points + 1)
        order = np.argsort(values, kind="stable")
        n = sum(n for n, _ in parts)
        out.append((n, values[order], np.cumsum(weights[order]) / n))
    return out


def _cut(bracket: Bracket, rank: int, values: np.ndarray, shares: np.ndarray, accuracy: int) -> tuple[float, float]:
    """Two values around a rank. They only save work: rows are counted on both sides of them."""
    slack = 2.0 * (1.0 / min(SKETCH_POINTS, max(10, accuracy // 5)) + 1.0 / accuracy)
    at = (rank - bracket.before + 0.5) / max(bracket.inside, 1)
    low = int(np.searchsorted(shares, at - slack)) - 1
    high = int(np.searchsorted(shares, at + slack))
    return float(values[max(low, 0)]), float(values[min(high, len(values) - 1)])


def _narrowed(rank: int, b: Bracket, low: float, high: float, counts: Sequence[int]) -> Bracket | float:
    """The part of a bracket that holds a rank, or the value there, from the exact counts below, at and between the two values."""
    below, at_low, between, at_high = counts
    place = rank - b.before
    if place < below:
        return Bracket(b.column, b.low, low, b.before, below)
    if place < below + at_low:
        return low
    if place < below + at_low + between:
        return Bracket(b.column, low, high, b.before + below + at_low, between)
    if place < below + at_low + between + at_high:
        return high
    passed = below + at_low + between + at_high
    return Bracket(b.column, high, b.high, b.before + passed, b.inside - passed)


def _selected(
    rows: DataFrame,
    columns: int,
    ranks: Callable[[int], Sequence[int]],
    accuracy: int,
    few: int,
    guess: Callable[[int, int], tuple[float, float]] | None = None,
) -> tuple[list[int], dict]:
    """Rows per column and the value at each of its ranks, `{(column, rank): value}`.

    Rounds of sketching and counting: two values around a rank come from a sketch of the bracket that holds it, and the rows
    below, at, between and above them are counted. The part that holds the rank is the next bracket, whether the
    sketch was right or not, and the two values are never looked at again; so every round ends, and no answer depends
    on the sketch. Brackets of few rows are fetched. A `guess` of the two values stands in for the first sketch."""
    cells = [F.col(f"v{i}") for i in range(columns)]
    first = [] if guess else _sketched(rows, cells, accuracy)
    sizes = [n for n, _, _ in first] or list(rows.agg(*(F.count(c) for c in cells)).first())
    found: dict[tuple[int, int], float] = {}
    open_ = {(i, r): Bracket(i, None, None, 0, n) for i, n in enumerate(sizes) if n for r in ranks(n)}
    sketches = {Bracket(i, None, None, 0, n): (v, s) for i, (n, v, s) in enumerate(first)}

    def values_around(b: Bracket, rank: int) -> tuple[float, float]:
        return guess(b.inside, rank) if guess and whole(b) else _cut(b, rank, *sketches[b], accuracy)

    def whole(b: Bracket) -> bool:
        return b.low is None and b.high is None

    while large := {k: b for k, b in open_.items() if b.inside > few}:
        unknown = [b for b in dict.fromkeys(large.values()) if b not in sketches and not (guess and whole(b))]
        if unknown:
            inside = [F.when(b.holds(cells[b.column]), cells[b.column]) for b in unknown]
            sketches |= {b: (v, s) for b, (_, v, s) in zip(unknown, _sketched(rows, inside, accuracy), strict=True)}
        cuts = {k: (b, *values_around(b, k[1])) for k, b in large.items()}
        counted = list(dict.fromkeys(cuts.values()))  # a bracket and two values each
        row = rows.agg(*(c for b, low, high in counted for c in _counts(b, low, high, cells[b.column]))).first()
        counts = {cut: row[4 * j : 4 * j + 4] for j, cut in enumerate(counted)}
        for (i, rank), cut in cuts.items():
            part = _narrowed(rank, *cut, counts[cut])
            if isinstance(part, Bracket):
                open_[i, rank] = part
            else:
                found[i, rank] = part
                del open_[i, rank]
    fetched = list(dict.fromkeys(open_.values()))
    if fetched:
        hits = [F.when(b.holds(cells[b.column]), F.struct(F.lit(j).alias("j"), cells[b.column].alias("v"))) for j, b in enumerate(fetched)]
        long = rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).where("h.v IS NOT NULL")
        values: dict[int, list] = {}
        for r in long.groupBy("h.j", "h.v").count().collect():  # at most FEW_ROWS a bracket
            values.setdefault(r["j"], []).append((r["v"], r["count"]))
        for (i, rank), b in open_.items():
            ordered = sorted(values[fetched.index(b)])
            upto = np.cumsum([n for _, n in ordered])
            found[i, rank] = ordered[int(np.searchsorted(upto, rank - b.before, side="right"))][0]
    return sizes, found


def _counts(b: Bracket, low: float, high: float, v: Column) -> list[Column]:
    inside = b.holds(v)
    return [
        F.count_if(inside & (v < low)),
        F.count_if(inside & (v == low)),
        F.count_if(inside & (v > low) & (v < high)),
        F.count_if(inside & (v == high)) if high > low else F.lit(0).cast("bigint"),
    ]


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    fractions: Sequence[float],
    position: Callable[[int, float], float] = linear_position,
    accuracy: int = SKETCH_ACCURACY,
    few: int = FEW_ROWS,
    guess: Callable[[int, int], tuple[float, float]] | None = None,
) -> DataFrame:
    """Exact quantiles per column: rows `(column, n, quantiles ARRAY<DOUBLE>)`, none for a column without values.

    `columns` maps a label to a DOUBLE expression that is NULL where missing. The ranks are selected in rounds
    of scans that all columns share; no scan sorts or moves rows, and what comes to the driver is bounded by the
    number of columns and ranks. Where the values follow a known law, `guess` (rows, rank) -> two values around the rank
    saves the first sketch.
    """
    names = list(columns)

    def ends(n: int) -> list[int]:
        places = [position(n, f) for f in fractions]
        return sorted({min(max(e, 0), n - 1) for p in places for e in (math.floor(p), math.ceil(p))})

    rows = df.select(*(c.alias(f"v{i}") for i, c in enumerate(columns.values())))
    sizes, found = _selected(rows, len(names), ends, accuracy, few, guess)
    out = []
    for i, n in enumerate(sizes):
        quantiles = []
        for f in fractions if n else ():
            p = min(max(position(n, f), 0), n - 1)
            a, b = found[i, math.floor(p)], found[i, math.ceil(p)]
            # equal ends first: keeps infinite values out of the subtraction
            quantiles.append(a if a == b else a + (b - a) * (p - math.floor(p)))
        if n:
            out.append((names[i], n, quantiles))
    return df.sparkSession.createDataFrame(out, "column string, n bigint, quantiles array<double>")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in `spark.checkpoint.dir`. A local
    session that names none gets a temporary one; a cluster has to name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkassay-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path for one new table in the shared folder."""
    return f"{shared_folder(spark)}/sparkassay/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The table written to the shared folder and read back: its rows are settled from here on,
    whatever executors are lost."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    position: str = "position",
    size: str | None = None,
    window_rows: int = WINDOW_ROWS,
    between: tuple[int, int] | None = None,
    sizes: tuple[int, int | None] | None = None,
) -> DataFrame:
    """Number the rows of every group from 0 along `order`; `size` adds the group's row count and
    `between` keeps the positions from its first to before its second number. `sizes` gives the rows of the
    largest group and of the table where they are known.

    Small groups (the largest is counted first) take one window per group. Otherwise the rows are
    range-partitioned by (keys, order) and written once; each block is numbered on its own, and the
    start of a block is the sum of the blocks before it. No task holds more than one block.
    """
    largest, rows = sizes or group_sizes(df, keys)
    if largest > window_rows and rows is None:
        rows = df.count()
    first, end = between or (0, rows)
    wanted = (F.col(position) >= first) & (F.col(position) < end) if between else F.lit(True)
    if largest <= window_rows:
        return _window_positions(df, order, keys, position, size).where(wanted)
    blocks = to_blocks(df, order, keys, block_count(df, rows, window_rows))
    groups = [GROUP] if keys else []
    starts = block_starts(blocks.groupBy(*groups, BLOCK).agg(F.count("*").alias("_rows")), groups, ["_rows"])
    if between:
        starts = starts.where((F.col("_rows_before") < end) & (F.col("_rows_before") + F.col("_rows") > first))
    # without keys there is one start per block, a number that block_count bounds
    joined = blocks.join(starts if keys else F.broadcast(starts), [*groups, BLOCK])
    in_block = Window.partitionBy(*groups, BLOCK).orderBy(*order)
    out = joined.withColumn(position, F.row_number().over(in_block) - 1 + F.col("_rows_before"))
    if size:
        out = out.withColumn(size, F.col("_rows_total"))
    return out.where(wanted).drop(*groups, BLOCK, "_rows", "_rows_before", "_rows_total")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of the table."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    largest, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, rows or 0


def block_count(df: DataFrame, rows: int, block_rows: int) -> int:
    """How many blocks to cut a table into: enough for the rows and for the cluster, but not so
    many that their list itself becomes large."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, min(MOST_BLOCKS, -(-rows // block_rows)))


def _window_positions(df, order, keys, position, size):
    # Without keys the one group is known to be small here; a constant key keeps the window keyed.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    out = df.withColumn(position, F.row_number().over(group.orderBy(*order)).cast("long") - 1)
    return out.withColumn(size, F.count("*").over(group)) if size else out


def to_blocks(df: DataFrame, order: Sequence[str], keys: Sequence[str], blocks: int) -> DataFrame:
    """Rows in range-partitioned blocks along (keys, order), written once so that the block of a
    row is settled. Column `_block` ascends along the order; with keys, `_group` names the group
    in one text that is never NULL, so that joins and windows by it share a partitioning."""
    ranged = df.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    if keys:
        ranged = ranged.withColumn(GROUP, F.to_json(F.struct(*keys)))
    return written(ranged, "blocks")


def block_starts(totals: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per (group, block): what `columns` sum to before the block and in the whole group. A group
    has at most one row per block here."""
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    out = totals
    for c in columns:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(before), F.lit(0)))
        out = out.withColumn(f"{c}_total", F.sum(c).over(group))
    return out
