"""Heads, random samples and pages of tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.operators.ranks import BLOCK, WINDOW_ROWS, block_count, new_folder, order_statistics

# Rows of a block that a page is cut from, roughly; one task numbers one block.
PAGE_BLOCK_ROWS = 1_000_000
# A table is cut into no more blocks than this, however small they were asked for, until they hold WINDOW_ROWS: each is a
# task that reports to the driver, and a place that the range partitioning samples rows for there.
MOST_PAGE_BLOCKS = 200
# Pages up to this many rows are broadcast to fetch their rows.
BROADCAST_ROWS = 100_000
#: Hexadecimal digits of a row's draw that are compared as one number; a double holds them exactly.
DIGITS = 13


def sample_head(df: DataFrame, limit: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """The first rows, along an order if one is given."""
    return (df.orderBy(*order) if order else df).limit(limit)


def row_draw(df: DataFrame, seed: int, key: Sequence[str] = ()) -> Column:
    """The draw of a row: an MD5 of the seed and the columns that name the row (all of them by default), as hexadecimal
    text. It belongs to the row, so samples do not change with partitions, order or retries."""
    if not key:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json(F.struct(*(V.col(c) for c in df.columns)))))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(V.col(c).cast("string"), F.lit("")) for c in key)))


def sample_rows(df: DataFrame, percentage: float = 10.0, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """max(10, int(percentage)) random rows: those of the smallest draws. Each task keeps only that many."""
    return df.orderBy(row_draw(df, seed, key)).limit(max(10, int(percentage)))


def sample_fraction(df: DataFrame, percentage: float = 0.1, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """max(1, int(rows * percentage)) random rows, those of the smallest draws; none of an empty table.

    The sample grows with the table, so it is not a top-k: the draw at the wanted rank is selected, and rows below it
    are kept where they are. Rows of one draw are decided by the rest of its digits, and rows that are alike
    in all of `key` by their place in the table (a file scan; any choice among equal rows is as good).
    """
    draw = row_draw(df, seed, key)
    levels = [F.conv(F.substring(draw, start, DIGITS), 16, 10).cast("double") for start in (1, DIGITS + 1)]
    levels.append(F.monotonically_increasing_id().cast("double"))
    rows = df.select(*(V.col(c) for c in df.columns), *(level.alias(f"_draw{i}") for i, level in enumerate(levels)))
    names = [f"_draw{i}" for i in range(len(levels))]

    def wanted(n: int, share: float) -> float:
        return max(1, int(n * share)) - 1

    def around(n: int, rank: int) -> tuple[float, float]:
        """Draws are spread evenly: six standard deviations on both sides of a rank."""
        p = (rank + 0.5) / n
        off = 6 * math.sqrt(p * (1 - p) / n) + 1 / n
        return max(0.0, p - off) * 16**DIGITS, min(1.0, p + off) * 16**DIGITS

    left, kept, tied = None, F.lit(False), F.lit(True)
    for name in names:
        here, number = rows.where(tied), F.col(name)
        rank = wanted if left is None else lambda n, _, left=left: left - 1
        found = order_statistics(here.select(name), {"draw": number}, [percentage], position=rank, guess=None if name == names[-1] else around).first()
        if found is None:  # an empty table
            return df
        at = F.lit(found["quantiles"][0])
        left = int(wanted(found["n"], percentage)) + 1 if left is None else left
        below, equal = here.agg(F.count_if(number < at), F.count_if(number == at)).first()
        if below + equal == left:
            kept = kept | (tied & (number <= at))
            break
        kept, tied, left = kept | (tied & (number < at)), tied & (number == at), left - below
    return rows.where(kept).drop(*names)


def sample_tables(
    tables: Mapping[str, DataFrame], percentage: float = 0.1, seed: int = 42, keys: Mapping[str, Sequence[str]] | None = None
) -> dict[str, DataFrame]:
    """`sample_fraction` of every table; `keys` names the columns that name a table's rows."""
    keys = keys or {}
    return {name: sample_fraction(df, percentage, seed, keys.get(name, ())) for name, df in tables.items()}


class PageDirectory:
    """Pages of a table along a unique order, from a directory of blocks.

    The order columns alone are range-partitioned once and written with a folder for each block; the directory holds how
    many rows every block has, one number a block. Any page, the first or the last, then reads only the blocks it touches, numbers
    them, and its few keys fetch the rows.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], block_rows: int = PAGE_BLOCK_ROWS):
        self.df, self.order = df, list(order)
        spark = df.sparkSession
        names = [f"_k{i}" for i in range(len(self.order))]
        keys = df.select(*(V.col(c).alias(n) for c, n in zip(self.order, names, strict=True)))
        rows = df.count()
        blocks = min(block_count(df, rows, block_rows), max(block_count(df, rows, WINDOW_ROWS), MOST_PAGE_BLOCKS))
        ranged = keys.repartitionByRange(blocks, *names).withColumn(BLOCK, F.spark_partition_id())
        path = new_folder(spark, "pages")
        ranged.write.partitionBy(BLOCK).parquet(path)
        schema = keys.withColumn(BLOCK, F.lit(0)).schema
        self.names, self.keys = names, spark.read.schema(schema).parquet(path)
        # a row per block; counts come from the files' footers
        self.sizes = sorted((r[BLOCK], r["count"]) for r in self.keys.groupBy(BLOCK).count().collect())
        self.total = sum(n for _, n in self.sizes)

    def page(self, page: int = 1, page_size: int = 10) -> DataFrame:
        """One page with `row_no` (from 1), `total_records` and `total_pages`."""
        if page < 1 or page_size < 1:
            raise ValueError("page and page_size must be at least 1")
        start, end, before, touched = (page - 1) * page_size, page * page_size, 0, {}
        for block, n in self.sizes:
            if before < end and before + n > start:
                touched[block] = before
            before += n
        starts = F.lit(0).cast("long")
        for block, first in touched.items():
            starts = F.when(F.col(BLOCK) == block, F.lit(first).cast("long")).otherwise(starts)
        in_block = Window.partitionBy(BLOCK).orderBy(*self.names)
        numbered = self.keys.where(F.col(BLOCK).isin(*touched)).withColumn("_row_no", starts + F.row_number().over(in_block))
        wanted = numbered.where((F.col("_row_no") > start) & (F.col("_row_no") <= end)).drop(BLOCK)
        # a page has page_size keys, whatever the table
        few = F.broadcast(wanted) if page_size <= BROADCAST_ROWS else wanted
        # a NULL in an order column is a place like any other
        same = [V.col(c).eqNullSafe(F.col(n)) for c, n in zip(self.order, self.names, strict=True)]
        rows = self.df.join(few, same).select(*(V.col(c) for c in self.df.columns), F.col("_row_no").alias("row_no"))
        pages = -(-self.total // page_size)
        rows = rows.orderBy("row_no")
        return rows.withColumn("total_records", F.lit(self.total).cast("long")).withColumn("total_pages", F.lit(pages).cast("long"))


def paginate(df: DataFrame, order: Sequence[str], page: int = 1, page_size: int = 10, block_rows: int = PAGE_BLOCK_ROWS) -> DataFrame:
    """One page of a table along a unique order; for several pages keep a `PageDirectory`."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be at least 1")
    return PageDirectory(df, order, block_rows).page(page, page_size)
