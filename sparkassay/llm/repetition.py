"""Quality rules by repetition coverage: how many characters lie inside repeated word n-grams and lines.

Rolling hashes of several n-gram lengths are taken in numpy, one document at a time. Documents are
independent of each other, so the operator is one column function without any shuffle.

Defined results: NULL and empty texts count nothing and fail the base rule; repeated rows each get
the same result; extra columns stay with their row; texts of any length are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Largest share of a text's word characters inside repeated n-grams, by n-gram length.
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30

# White space to Python but not to the word pattern: a text that has some takes the slower way.
_ODD_SPACES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER_SPACE = re.compile("[" + "".join(map(chr, _ODD_SPACES)) + "]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Words between ASCII white space."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of `total` words lie inside a window of `length` words at one of `starts`."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    equal = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def repeated_windows(ids: np.ndarray, distinct: int) -> np.ndarray:
    """True at the starts of 3-word windows that stand more than once. Exact: ids are word numbers,
    and pairs are numbered anew before the third word joins, so that no key overflows."""
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    return repeated(pairs[:-1] * distinct + ids[2:])


def measure(text: str | None, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    text = text or ""
    words = words_of(text)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    n_dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            if chars := len(line) - sum(line.count(c) for c in SPACES):
                n_dup_lines += 1
                dup_chars += chars
        else:
            seen.add(line)
    n_repeat, shares = 0, [0.0] * len(limits)
    if n >= 3:
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        triples = repeated_windows(ids, len(numbers))
        if triples.any():
            n_repeat = int(covered(np.flatnonzero(triples), 3, n).sum())
            sizes = np.fromiter(map(len, words), np.int64, n)
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            base, rolling, length = np.uint64(0xBF58476D1CE4E5B9), mixed, 1
            # a repeated n-gram is made of repeated 3-grams: only such starts can repeat
            possible = np.ones(n, bool)
            for k, size in enumerate(sorted(limits)):
                while length < size and len(rolling) > 1:
                    rolling = rolling[:-1] * base + mixed[length:]
                    length += 1
                if n < size:
                    break
                possible = np.convolve(triples, np.ones(size - 2, np.int64), "valid") == size - 2
                at = np.flatnonzero(possible)
                if not len(at):
                    break
                at = at[repeated(rolling[at])]
                shares[k] = float(sizes[covered(at, size, n)].sum() / word_chars) if len(at) else 0.0
    line_share = dup_chars / word_chars if word_chars else 0.0
    failed = n < 50 or 100 * n_repeat > 50 * n
    passed = line_share <= line_limit and all(s <= limits[k] for s, k in zip(shares, sorted(limits), strict=True))
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, line_share, shares, failed, passed and not failed


def repetition(text: Column, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> Column:
    """Struct of counts, coverages and verdict for a text column."""

    @F.pandas_udf(RESULT)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t, limits, line_limit) for t in texts], columns=names)

    return measured(text)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document row: its id, counts, coverages and whether it is kept."""
    return docs.select(F.col("doc_id"), repetition(F.col("text")).alias("_r")).select("doc_id", "_r.*")
