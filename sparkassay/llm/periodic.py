"""Periodic runs of words: a passage said over and over, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
`LEAST_WORDS` words and `LEAST_TURNS` periods long, that no neighbouring word extends keeping period q.

In a run every word stands at least `LEAST_TURNS` times. So a word that stands less often within the current segment is in no
run inside it, and splits the segment there. The parts are counted anew and split again until nothing changes:
a text without repetition falls to pieces after a few rounds. Surviving segments are scanned lag by lag. For lags
of [P, 2P) a run matches itself over more than 2P words from its first anchor on, where every P-th word is an anchor, so only
the grams at anchors are looked up at the lags, by a rolling hash: about one comparison per word and
power of two. What matches is extended word by word, exactly, and a stretch inside a run whose period
divides the lag is that run again. Hashes only nominate, so results are exact.

Each document is worked on alone: one column function, no shuffle.

Defined results: NULL and empty texts have no words and no runs; a word is what stands between ASCII white space; texts
of any length are scanned whole, in time near linear in their words; repeated rows get equal results; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import SPACED_WORD
from sparkassay.llm.repetition import words_of

#: Words and periods of the shortest run.
LEAST_WORDS, LEAST_TURNS = 6, 4
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def segments(ids: np.ndarray, least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int]]:
    """[start, end) of what is left when words that are too rare within their segment have split it, to stability."""
    out, open_ = [], [(0, len(ids))]
    while open_:
        # all open segments are counted at once: a word is numbered by its segment and itself
        starts = np.array([s for s, _ in open_])
        sizes = np.array([e - s for s, e in open_])
        of = np.repeat(np.arange(len(open_)), sizes)
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
        _, number, counts = np.unique(of * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        rare = counts[number] < turns
        split = np.zeros(len(open_), bool)
        split[of[rare]] = True
        out += [open_[i] for i in np.flatnonzero(~split)]
        if not rare.any():
            break
        # stretches of frequent words in the segments that were split
        alive = ~rare & split[of]
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (of[1:] != of[:-1]) | (alive[1:] != alive[:-1])
        cuts = np.flatnonzero(edge)
        kept = [i for i in range(len(cuts) - 1) if alive[cuts[i]] and cuts[i + 1] - cuts[i] >= least_words]
        open_ = [(int(at[cuts[i]]), int(at[cuts[i + 1] - 1]) + 1) for i in kept]
    return sorted(out)


def _reach(same: np.ndarray) -> int:
    """How many leading entries are true."""
    stop = int(same.argmin()) if len(same) else 0
    return stop if stop < len(same) and not same[stop] else len(same)


def _matching(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest [l, r) around `at` where w[i] == w[i + lag]."""
    right, step = at, 64
    while right < len(w) - lag:
        stop = min(right + step, len(w) - lag)
        n = _reach(w[right:stop] == w[right + lag : stop + lag])
        right += n
        if right < stop:
            break
        step *= 2
    left, step = at, 64
    while left > 0:
        stop = max(left - step, 0)
        n = _reach((w[stop:left] == w[stop + lag : left + lag])[::-1])
        left -= n
        if left > stop:
            break
        step *= 2
    return left, right


def scan(w: np.ndarray, least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a segment."""
    n, found = len(w), []
    # per word, how far the runs reach that begin at or before it
    reach = np.zeros(n, np.int64)
    grams, size = (w.astype(np.uint64) + np.uint64(1)) * _BASE, 1
    grams ^= grams >> np.uint64(31)
    power, scale = int(_BASE), 1
    while turns * scale <= n:
        # so many words, at least, of a run of such a lag match the words a lag further on, from its first anchor on
        matching = max(least_words, turns * scale) - 2 * scale + 1
        while 2 * size <= matching:
            grams = grams[:-size] * np.uint64(power) + grams[size:]
            power, size = power * power % (1 << 64), size * 2
        anchors = np.arange(0, len(grams), scale)
        nominated = _lag_by_lag(grams, anchors, scale) if scale < 64 else _anchor_by_anchor(grams, anchors, scale)
        for lag, hits in nominated:
            # what lies inside a known run is that run again: its period divides the lag
            hits = hits[reach[hits] < hits + lag + size]
            i = 0
            while i < len(hits):
                at = int(hits[i])
                left, right = _matching(w, at, lag)
                length = right - left + lag
                if length >= max(least_words, turns * lag):
                    if reach[left] < left + length:
                        found.append((left, length, lag))
                    np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
                i = int(np.searchsorted(hits, max(right, at + 1)))
        scale *= 2
    return found


def _lag_by_lag(grams: np.ndarray, anchors: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, anchors) where the gram at an anchor stands again at a lag in [scale, 2 * scale), by lag: few lags."""
    at_anchors = grams[::scale]
    for lag in range(scale, 2 * scale):
        beyond = grams[lag::scale]
        hits = anchors[: len(beyond)][at_anchors[: len(beyond)] == beyond]
        if len(hits):
            yield lag, hits


def _anchor_by_anchor(grams: np.ndarray, anchors: np.ndarray, scale: int) -> list[tuple[int, np.ndarray]]:
    """The same where there are many lags and few anchors."""
    pairs = []
    for at in anchors:
        again = np.flatnonzero(grams[at + scale : at + 2 * scale] == grams[at])
        if len(again):
            pairs.append(np.stack([again + scale, np.full(len(again), at)]))
    if not pairs:
        return []
    lags, places = np.concatenate(pairs, axis=1)
    order = np.lexsort((places, lags))
    lags, places = lags[order], places[order]
    cuts = np.flatnonzero(np.r_[True, lags[1:] != lags[:-1], True])
    return [(int(lags[a]), places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def runs_of(words: list[str], least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start and period."""
    if len(words) < least_words:
        return []
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    out = [
        (start + a, length, period)
        for start, end in segments(ids, least_words, turns)
        for a, length, period in scan(ids[start:end], least_words, turns)
    ]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return " ".join(words[i] for i in kept)


def periodic_runs(text: Column, least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> Column:
    """Struct (n_words, runs, collapsed) of a text column. `turns` is at least 3, `least_words` at least 4."""
    if turns < 3 or least_words < 4:
        raise ValueError("runs need at least 3 turns and 4 words")

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t or "")
                runs = runs_of(words, least_words, turns)
                rows.append((len(words), [{"start": a, "length": n, "period": q} for a, n, q in runs], collapsed(words, runs)))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return found(text)


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, its runs and its text without what repeats."""
    return docs.select(F.col("doc_id"), periodic_runs(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def rewritten(doc_id: Column, text: Column) -> Column:
    """The contract's test texts: in documents whose crc32(id) ends in 0 the words from word a on repeat the p words from a on;
    other texts, those without words and those of a NULL id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = F.try_mod(g, n)
    rest = n - a
    p = F.floor(rest / (3 + g % 8)) + 1
    turns = F.ceil(rest / p)
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), turns.cast("int")))
    new = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), rest.cast("int")))
    touched = (h % 10 == 0) & text.rlike(SPACED_WORD)
    return F.when(touched, F.concat_ws(" ", new)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from documents and their runs."""
    runs = F.col("runs")
    # greatest length first, then smallest start and period
    ranked = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    one = found.select("doc_id", "n_words", "runs", "collapsed", ranked.alias("_b"))
    length, period = -F.col("_b.l"), F.col("_b.p")
    return one.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("_b.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
