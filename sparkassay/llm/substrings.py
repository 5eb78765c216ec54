"""Substring dedup by content-defined chunks.

A gear hash rolls over the characters; where its low bits are zero a chunk may end, so an insertion moves
cuts only near itself. A cut counts only if the candidate before it is at least SHORTEST characters
back, and stretches of more than LONGEST are cut evenly from their start: both rules look at nearby text alone.
Chunks are grouped by a 128-bit digest; the first in the order of (doc_id, text hash, place) stays. Further copies are
seeds: where they stand side by side over SEED characters, the ends of each stretch that runs along one first copy are
extended, character by character, with the text around that first copy. Runs of at least RUN characters are then taken out.
Tasks shuffle only the first place of a digest among the chunks they gather; further places never meet by digest.

Defined results: NULL counts as the empty text and loses nothing; rows that repeat id and text are one
document and all keep their first copies; documents without id come first; a text that repeats itself keeps its first
copy; an empty table gives no rows; texts of any length are chunked whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import keyed, release, settled

#: A cut may come about every MASK + 1 characters; lengths in characters.
MASK, SHORTEST, LONGEST, RUN = 15, 8, 64, 100
#: Copies side by side over so many characters are extended, by at most AROUND characters on either side. Only a stretch
#: without any possible cut could be equal beyond that without being a seed itself.
SEED, AROUND = 32, 512
#: An extension keeps to words of up to so many characters.
WORD = 32
#: Chunks that a task gathers before it hands them on.
TOGETHER = 500_000
#: The gear hash looks back over so many characters.
REACH = 32


def gear() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 4096, dtype=np.uint64)


def cuts(text: str, table: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, the last at its length."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    h = table[(points ^ (points >> 12)) & 4095]
    # sums of the last 1, 2, 4, ... values, each shifted by its age: the bits above the reach fall out
    width = 1
    while width < REACH:
        older = h[:-width] if width < n else h[:0]
        grown = h.copy()
        grown[width:] += older << np.uint64(width)
        h, width = grown, width * 2
    candidates = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    candidates = candidates[candidates < n]
    far = np.diff(candidates, prepend=-SHORTEST) >= SHORTEST
    ends = np.append(candidates[far], n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) <= LONGEST:
        return ends
    pieces = -(-gaps // LONGEST)
    starts = np.repeat(ends - gaps, pieces)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(starts + (number + 1) * LONGEST, np.repeat(ends, pieces))


def chunks(documents: DataFrame) -> DataFrame:
    """(_further, _high, _low, doc_id, _hash, _start, _size, _group) of every chunk. A task gathers chunks; the first place of
    a digest among them is a row with _further false, and its _group is NULL unless further places of the digest follow."""

    def gathered(parts: list[tuple], group: int) -> Iterator[pa.RecordBatch]:
        # documents in the order of places, so that a stable sort by digest finds the first one
        parts.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        counts = [len(p[2]) for p in parts]
        halves = np.concatenate([np.frombuffer(p[4], "<i8").reshape(-1, 2) for p in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        start, size = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (2, 3))
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        ordered = halves[order]
        further, several = np.zeros(len(order), bool), np.zeros(len(order), bool)
        equal = (ordered[1:] == ordered[:-1]).all(axis=1)
        further[order[1:][equal]] = True
        several[order[1:][equal]] = several[order[:-1][equal]] = True
        ids = pa.array([p[0] for p in parts], pa.int64())
        hashes = pa.array([p[1] for p in parts], pa.int64())
        for a in range(0, len(order), 50_000):
            i = slice(a, a + 50_000)
            back = pa.array(owner[i])
            columns = [pa.array(further[i]), pa.array(halves[i, 0]), pa.array(halves[i, 1]), ids.take(back), hashes.take(back)]
            groups = pa.array(np.full(len(back), group, np.int64), mask=~several[i])
            columns += [pa.array(start[i]), pa.array(size[i]), groups]
            yield pa.RecordBatch.from_arrays(columns, ["_further", "_high", "_low", "doc_id", "_hash", "_start", "_size", "_group"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        table, digest = gear(), xxhash.xxh3_128_digest
        group, parts, waiting = TaskContext.get().partitionId() << 32, [], 0
        for rows in batches:
            for doc_id, mark, text in zip(rows["doc_id"].to_pylist(), rows["_hash"].to_pylist(), rows["_text"], strict=True):
                text = text.as_py()
                if not text:
                    continue
                end = cuts(text, table)
                start = np.concatenate([[0], end[:-1]])
                edges = zip(start.tolist(), end.tolist(), strict=True)
                if text.isascii():
                    raw = text.encode()
                    found = b"".join([digest(raw[a:b]) for a, b in edges])
                else:
                    found = b"".join([digest(text[a:b].encode()) for a, b in edges])
                parts.append((doc_id, mark, start, end - start, found))
                waiting += len(end)
                if waiting > TOGETHER:
                    yield from gathered(parts, group)
                    group, parts, waiting = group + 1, [], 0
        if parts:
            yield from gathered(parts, group)

    return documents.select("doc_id", "_hash", "_text").mapInArrow(
        work, "_further boolean, _high long, _low long, doc_id long, _hash long, _start int, _size int, _group long"
    )


def _copies(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_high, _low, doc_id, _hash, _start, _end, _first) of the chunks of which an earlier copy stands elsewhere, and the
    settled table that this reads.

    One shuffle by digest: what is first in a gathering meets there, a row for each gathering at most, however many texts
    share a digest, and a running first place tells the copies apart. Further places of a gathering are only dealt out by
    their own place, and then looked up by gathering and digest. Tasks that are run again have to be given the same rows,
    as those of files are."""
    place = F.struct("doc_id", "_hash", "_start")
    salted = chunks(documents).withColumn("_salt", F.when(F.col("_further"), F.xxhash64("doc_id", "_hash", "_start")))
    running = Window.partitionBy("_high", "_low", "_further", "_salt").orderBy("doc_id", "_hash", "_start")
    first = F.first(place).over(running.rowsBetween(Window.unboundedPreceding, 0))
    known = salted.withColumn("_first", F.when(~F.col("_further"), first)).drop("_salt")
    known = settled(known.where(F.col("_group").isNotNull() | ~place.eqNullSafe(F.col("_first"))), "repeated")
    heads = known.where("NOT _further")
    firsts = heads.where("_group IS NOT NULL").select("_group", "_high", "_low", "_first")
    later = known.where("_further").drop("_first").join(firsts, ["_group", "_high", "_low"])
    copies = heads.unionByName(later).where(~place.eqNullSafe(F.col("_first")))
    return copies.select("_high", "_low", "doc_id", "_hash", "_start", (F.col("_start") + F.col("_size")).alias("_end"), "_first"), known


def repeats(documents: DataFrame) -> DataFrame:
    """(_id, _mark, _places): per document the chunks of which an earlier copy stands elsewhere."""
    copies, known = _copies(documents)
    copies = copies.repartition("doc_id", "_hash").distinct()  # rows that repeat id and text
    text = Window.partitionBy("doc_id", "_hash").orderBy("_start")
    beside = F.coalesce(F.lag("_end").over(text) == F.col("_start"), F.lit(False))
    source = F.struct("_first.doc_id", "_first._hash", (F.col("_start") - F.col("_first._start")).alias("_shift"))
    copies = copies.withColumn("_source", source).withColumn("_beside", beside)
    copies = copies.withColumn("_along", F.col("_beside") & F.lag("_source").over(text).eqNullSafe(F.col("_source")))
    copies = copies.withColumn("_last", ~F.coalesce(F.lead("_along").over(text), F.lit(False)))
    copies = copies.withColumn("_stretch", F.sum((~F.col("_beside")).cast("int")).over(text))
    stretch = Window.partitionBy("doc_id", "_hash", "_stretch")
    length = F.max("_end").over(stretch) - F.min("_start").over(stretch)
    copies = copies.withColumn("_length", length).where(F.col("_length") >= SEED)
    # one row for a run along one first copy: its first chunk, with its last
    chunk = F.struct("_high", "_low", "_first", "_start", "_end")
    ends = copies.withColumn("_opens", ~F.col("_along")).where("_opens OR _last").withColumn("_chunk", chunk)
    closing = F.when(F.col("_last"), F.col("_chunk")).otherwise(F.lead("_chunk").over(text))
    runs = ends.withColumn("_closing", closing).where("_opens").select("doc_id", "_hash", "_chunk", "_closing")
    runs = settled(runs, "copies")
    release(known)
    sides = F.array(F.struct(F.lit(True).alias("_left"), F.col("_chunk")), F.struct(F.lit(False).alias("_left"), F.col("_closing").alias("_chunk")))
    outer = runs.select("doc_id", "_hash", F.col("_chunk._start").alias("_start"), F.col("_closing._end").alias("_end"), F.explode(sides).alias("_s"))
    outer = outer.select("doc_id", "_hash", "_start", "_end", "_s._left", "_s._chunk._high", "_s._chunk._low")
    around = settled(_around(documents, runs.select(F.inline(sides))), "around")
    joined = outer.join(around, F.expr("_left = _before AND _high = _h AND _low = _l"), "left")
    left, right = F.when(F.col("_left"), F.col("_side")), F.when(~F.col("_left"), F.col("_side"))
    places = joined.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_mark")).agg(
        F.sort_array(F.collect_list(F.struct("_start", "_end", left.alias("_left"), right.alias("_right")))).alias("_places")
    )
    places = settled(places, "places")
    release(runs)
    release(around)
    return places


def _around(documents: DataFrame, ends: DataFrame) -> DataFrame:
    """(_before, _h, _l, _side): the text on one side of the first copy of each of these chunks, once a chunk and side."""
    place, size = F.col("_chunk._first"), (F.col("_chunk._end") - F.col("_chunk._start")).alias("_size")
    wanted = ends.select("_left", "_chunk._high", "_chunk._low", size, place["doc_id"].alias("_id"), place["_hash"].alias("_mark"), place["_start"].alias("_at"))
    wanted = wanted.distinct().groupBy("_id", "_mark").agg(F.collect_list(F.struct("_left", "_high", "_low", "_at", "_size")).alias("_wanted"))
    # rows that repeat id and text would all give the same
    found = documents.join(wanted, F.expr("doc_id <=> _id AND _hash = _mark"))

    @F.pandas_udf("array<struct<_before:boolean,_h:long,_l:long,_side:string>>")
    def sides(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for text, chosen in zip(texts, lists, strict=True):
                row = []
                for c in chosen:
                    a = c["_at"]
                    b = a + c["_size"]
                    side = text[max(0, a - AROUND) : a] if c["_left"] else text[b : b + AROUND]
                    row.append({"_before": c["_left"], "_h": c["_high"], "_l": c["_low"], "_side": side})
                out.append(row)
            yield pd.Series(out)

    return found.select(F.inline(sides("_text", "_wanted"))).dropDuplicates(["_before", "_h", "_l"])


def shared_start(one: str, two: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(one), len(two))
    while low < high:
        half = (low + high + 1) // 2
        if one[low:half] == two[low:half]:
            low = half
        else:
            high = half - 1
    return low


def word_start(text: str, first: int, start: int) -> int:
    """The place in first to start where a word begins, so that letters that happen to be alike before a
    passage stay; `first` where no word of up to WORD characters begins."""
    if first == 0 or text[first - 1].isspace():
        return first
    return next((k + 1 for k in range(first, min(start, first + WORD)) if text[k].isspace()), first)


def word_end(text: str, end: int, last: int) -> int:
    """The place in end to last where a word has ended; `last` where none of up to WORD characters has."""
    if last == len(text) or text[last].isspace():
        return last
    return next((k for k in range(last, max(end, last - WORD), -1) if text[k - 1].isspace()), last)


def cut_out(text: Column, places: Column) -> Column:
    """Struct of the text without its runs of repeated chunks, and the runs."""

    @F.pandas_udf("text string, spans array<struct<start:int,end:int>>, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, found in zip(texts, lists, strict=True):
                if found is None or not len(found):
                    out.append((text, [], 0))
                    continue
                spans = []
                for p in found:
                    start, end = int(p["_start"]), int(p["_end"])
                    if p["_left"]:
                        first = start - shared_start(text[max(0, start - AROUND) : start][::-1], p["_left"][::-1])
                        start = word_start(text, first, start)
                    if p["_right"]:
                        last = end + shared_start(text[end : end + AROUND], p["_right"])
                        end = word_end(text, end, last)
                    spans.append((start, end))
                runs: list[list[int]] = []
                for start, end in sorted(spans):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                runs = [r for r in runs if r[1] - r[0] >= RUN]
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text
                out.append((kept, [{"start": int(a), "end": int(b)} for a, b in runs], int(sum(b - a for a, b in runs))))
            yield pd.DataFrame(out, columns=["text", "spans", "n_removed"])

    return cut(text, places)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, text without repeated passages, spans (start, end in
    characters of the given text), n_chars (of the given text), n_removed."""
    documents = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = repeats(documents)
    joined = documents.join(found, F.expr("doc_id <=> _id AND _hash = _mark"), "left")
    out = joined.select("doc_id", F.length("_text").cast("long").alias("n_chars"), cut_out(F.col("_text"), F.col("_places")).alias("_r"))
    return out.select("doc_id", "_r.text", "_r.spans", "n_chars", "_r.n_removed")
