"""Packing of token sequences by non-negative least squares over length combinations.

Texts are tokenised once; each is cut into full windows and one rest. The lengths of the rests form a
histogram of bins. Combinations of at most DEPTH bins that fill a window exactly are enumerated,
their repeat counts solved against the histogram with non-negative least squares and rounded, and
what the rounding leaves over is packed greedily, longest first, into the best-fitting gap, bin counts at a time. Plan and
histogram are of fixed size (BINS bins); rows are dealt to their places by ranks inside a bin,
counted in salted blocks, so that no length gathers in one task.

Defined results: NULL counts as the empty text, a document of the end token alone; documents that
repeat id and text are packed each on their own; an empty table gives no rows; a text of any length
is cut into as many windows as it fills; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import settled


WINDOW, BINS, DEPTH = 4096, 256, 3
#: The tokeniser ends a document with this id.
END = 2
#: Rows that one task ranks, roughly.
BLOCK_ROWS = 50_000
#: Words whose ids a task remembers.
REMEMBERED = 600_000

# Words of ASCII and accented Latin letters need no normalising but lower case, and their parts follow
# this pattern of the tokeniser, a fixed value; any other word goes through the whole tokeniser.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every text as ids, cut into windows. A word between ASCII white space has the same ids
    wherever it stands with this tokeniser, so each task looks a repeated word up only once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer, pre_tokenizers

        model = Tokenizer.from_file(tokenizer)
        # words that hold a token the tokeniser adds to its model, in any case, are for the whole tokeniser
        added = re.compile("|".join(re.escape(t.content.lower()) for t in model.get_added_tokens_decoder().values()) or r"(?!)")
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        end = np.array([END], "<u4").tobytes()
        parts: dict[str, bytes] = {}
        merge = model.model.tokenize

        class Words(dict):
            def __missing__(self, raw: bytes) -> bytes:
                word = raw.decode()
                low = word.lower()
                if (ids := parts.get(low)) is None:
                    if not _PLAIN.fullmatch(word) or added.search(low):
                        ids = array("I", model.encode(word, add_special_tokens=False).ids).tobytes()
                    else:
                        ids = b"".join([parts[p] if p in parts else part_ids(p) for p in _PART.findall(low)])
                self[raw] = ids
                return ids

        def part_ids(part: str) -> bytes:
            raw = part if part.isascii() else bytes_of(part)[0][0]
            ids = parts[part] = array("I", [t.id for t in merge(raw)]).tobytes()
            return ids

        known = Words()

        def ids_of(words: list[bytes]) -> bytes:
            if len(known) > REMEMBERED:
                known.clear()
            if len(parts) > REMEMBERED:
                parts.clear()
            return b"".join([known[w] for w in words])

        for rows in batches:
            out = []
            for row, text in enumerate(rows["text"]):
                data = ids_of((text.as_py() or "").encode().split()) + end
                n = len(data) // 4
                for a in range(0, n, window):
                    part = data[a * 4 : (a + window) * 4]
                    ids = np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None
                    out.append((row, a, len(part) // 4, zlib.crc32(part), n, ids))
            row, start, length, crc, n, ids = zip(*out, strict=True) if out else [()] * 6
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, n)]
            doc_id = rows["doc_id"].take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_id, *longs, pa.array(ids, pa.list_(pa.int32()))], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECE)


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of at most `depth` bin numbers (1 to bins) that add up to `bins`."""

    def grow(least: int, left: int, parts: int) -> Iterator[tuple[int, ...]]:
        yield (left,)
        if parts > 1:
            for a in range(least, left // 2 + 1):
                for rest in grow(a, left - a, parts - 1):
                    yield (a, *rest)

    return list(grow(1, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson): columns join the passive set
    by largest gradient; a column that would turn negative leaves it."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    target = a.T @ b
    floor = 1e-9 * max(1e-3, np.abs(target).max(initial=0))
    for _ in range(rounds):
        gradient = np.where(passive, -np.inf, target - a.T @ (a @ x))
        if passive.all() or gradient.max() <= floor:
            break
        passive[int(gradient.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            s = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(at)), target[at])
            if (s > 0).all():
                break
            low = at[s <= 0]
            step = min(1.0, float((x[low] / (x[low] - s[s <= 0] + 1e-300)).min()))
            x[at] += step * (s - x[at])
            drop = passive & (x <= 1e-12)
            drop[low[np.argmin(x[low])]] = True
            passive &= ~drop
            x[~passive] = 0
            if not passive.any():
                break
        x[passive] = s if passive.any() else 0
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats) for a histogram of bin counts; bin k is at index k - 1. Every
    count is used up exactly."""
    bins, left = len(histogram), histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        present = set((np.flatnonzero(left) + 1).tolist())
        mixes = [m for m in combinations(bins, depth) if present.issuperset(m)]
        if mixes:
            a = np.zeros((bins, len(mixes)))
            for j, m in enumerate(mixes):
                for k in m:
                    a[k - 1, j] += 1
            repeats = np.rint(nnls(a, histogram / histogram.sum(), 4 * bins) * histogram.sum()).astype(np.int64)
            for j in np.argsort(-repeats, kind="stable"):
                need = np.unique(np.array(mixes[j]) - 1, return_counts=True)
                times = int(min(repeats[j], (left[need[0]] // need[1]).min()))
                if times > 0:
                    out.append((mixes[j], times))
                    left[need[0]] -= times * need[1]
    # what is left: best fit, longest first, many equal sequences at a time
    gaps: dict[int, list[list]] = {bins: []}
    for k in range(bins, 0, -1):
        while left[k - 1]:
            gap = next((g for g in range(k, bins) if gaps.get(g)), bins)
            if gap == bins:
                fit = bins // k
                times, last = divmod(int(left[k - 1]), fit)
                if times:
                    gaps.setdefault(bins - fit * k, []).append([(k,) * fit, times])
                if last:
                    gaps.setdefault(bins - last * k, []).append([(k,) * last, 1])
                left[k - 1] = 0
            else:
                mix, times = gaps[gap].pop()
                each = min(gap // k, max(1, -(-int(left[k - 1]) // times)))
                used = min(times, int(left[k - 1]) // each)
                if used < times:
                    gaps[gap].append([mix, times - used])
                gaps.setdefault(gap - each * k, []).append([mix + (k,) * each, used])
                left[k - 1] -= each * used
    return out + [(tuple(mix), times) for many in gaps.values() for mix, times in many]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, bins: int = BINS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the
    ids themselves with keep_ids)."""
    spark = docs.sparkSession
    width = window // bins
    cut = settled(pieces(docs, tokenizer, window, keep_ids), "pieces")
    if not keep_ids:
        cut = cut.drop("ids")
    bin_of = F.ceil(F.col("length") / width).cast("int")
    rows = cut.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    # equal rows may be told apart in any way: they are equal
    salted = cut.withColumn("_bin", bin_of).withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(1)), F.lit(blocks))
    )
    counts = salted.groupBy("_bin", "_salt").agg(F.count("*").alias("_n"))
    per_bin = {r["_bin"]: r["n"] for r in counts.groupBy("_bin").agg(F.sum("_n").alias("n")).collect()}
    histogram = np.array([per_bin.get(k, 0) for k in range(1, bins + 1)], np.int64)
    slots, sequence, used = [], 0, [0] * (bins + 1)
    for mix, times in plan(histogram):
        for place, k in enumerate(mix):
            slots.append((k, used[k], used[k] + times, sequence, place))
            used[k] += times
        sequence += times
    # a slot is a run of ranks of one bin; there are a few for each bin and depth, however many rows
    dealt = spark.createDataFrame(
        slots or [(0, 0, 0, 0, 0)], "_bin int, _first long, _end long, _sequence long, _place int"
    )
    before = Window.partitionBy("_bin").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    in_block = Window.partitionBy("_bin", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(in_block) - 1)
    ranked = ranked.join(starts, ["_bin", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    runs = dealt.groupBy("_bin").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_end", "_sequence", "_place"))).alias("_runs")
    )
    # the run of a rank: runs of a bin follow each other, so it is the last that begins at or before it
    found = F.expr("element_at(filter(_runs, r -> r._first <= _rank AND _rank < r._end), 1)")
    placed = ranked.join(F.broadcast(runs), "_bin").withColumn("_run", found)
    placed = placed.withColumn("sequence_id", F.col("_run._sequence") + F.col("_rank") - F.col("_run._first"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_place", F.col("_run._place")).withColumn(
        "offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names, *(["ids"] if keep_ids else []))
