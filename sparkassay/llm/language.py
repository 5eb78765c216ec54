"""Language identification of mixed text.

The script of a word narrows the languages it can be in; character n-grams score it; Viterbi with a
penalty for switching labels every word, and runs of one label are spans. The whole batch moves
through Viterbi together, one word of every text at a time, in numpy.

Counts are learned from a sample of bounded size (EXAMPLES texts a language, by a hash of the id).
Defined results: NULL texts and texts without letters are `und` with score 0; with nothing to learn
from, every text is; ties go to the language that sorts first; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import fold, share

#: Bound on the learning sample, in texts a language (met in expectation, by hash).
EXAMPLES = 600
ORDERS, BUCKETS = 3, 1 << 16
SWITCH = 6.0
#: A language is a candidate in a script if it writes at least this share of its letters in it.
SCRIPT_SHARE = 0.02
#: Texts are worked on together until they hold so many characters.
TOGETHER = 2_000_000
RESULT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

# First code points of script ranges, fixed values of the Unicode blocks; names in the same order.
SCRIPT_STARTS = (
    0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100,
    0x1200, 0x13A0, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0, 0x20000,
)
SCRIPT_NAMES = (
    "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "gurmukhi", "tamil",
    "telugu", "thai", "lao", "georgian", "hangul", "ethiopic", "other", "latin", "greek", "latin", "hiragana",
    "katakana", "han", "han", "other", "hangul", "other", "han",
)
SCRIPTS = sorted(set(SCRIPT_NAMES))


#: No letter stands here or beyond; the table's last entry answers for all of these.
LETTERS_END = 0x34000


def letters() -> np.ndarray:
    """True for every code point that is a letter; what lies beyond the table is none."""
    return np.fromiter((chr(i).isalpha() for i in range(LETTERS_END)), bool, LETTERS_END)


def split(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with every other sign as 0, starts and ends of the words in them, and the text of
    each word. Lower case may lengthen a text, so offsets are those of the lowered text."""
    lowered = [t.lower() for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter[np.minimum(points, len(letter) - 1)], points, 0)
    inside = points > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([1] + [len(t) + 1 for t in lowered])
    return points, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each code point, by length; a boundary counts as a sign."""
    p = points.astype(np.uint64)
    out, h = [], np.zeros(len(p), np.uint64)
    for n in range(ORDERS):
        h = h * np.uint64(0x100000001B3)
        h[n:] += p[: len(p) - n] + np.uint64(1)
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(48)).astype(np.int64))
    return out


def script_of(points: np.ndarray) -> np.ndarray:
    number = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])
    return number[np.searchsorted(np.array(SCRIPT_STARTS), points, side="right") - 1]


def _counts(texts: list[str], letter: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, bucket, count): n-grams inside words with the boundary after them, and letters by script."""
    points, starts, ends, _ = split(texts, letter)
    used = points > 0
    used[ends] = True  # the boundary that closes a word
    out = []
    for n, g in enumerate(grams(points)):
        c = np.bincount(g[used])
        out += [(n, int(b), int(c[b])) for b in np.flatnonzero(c)]
    c = np.bincount(script_of(points[points > 0]), minlength=len(SCRIPTS))
    return out + [(ORDERS, int(s), int(c[s])) for s in np.flatnonzero(c)]


def fit(docs: DataFrame, folds: int = 3, held: int = 1) -> dict:
    """Learn from text and language of the rows outside the held-out fold. n-grams are counted in
    Spark; what comes to the driver is at most BUCKETS counts per order and language."""
    known = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )
    known = known.where(fold(F.col("doc_id"), folds) != held)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": []}
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & share(F.col("doc_id"), EXAMPLES, n, 5))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = letters()
        for rows in batches:
            for lang, group in rows.groupby("lang"):
                found = _counts(list(group["text"]), letter)
                yield pd.DataFrame(found, columns=["kind", "bucket", "n"]).assign(lang=lang)

    rows = (
        known.where(chosen)
        .select("text", "lang")
        .mapInPandas(counted, "kind int, bucket int, n long, lang string")
        .groupBy("lang", "kind", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    langs = sorted(sizes)
    number = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((ORDERS, BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    for r in rows:
        (scripts if r["kind"] == ORDERS else table[r["kind"]])[r["bucket"], number[r["lang"]]] = r["n"]
    # share of an n-gram in a language, smoothed; longer n-grams say more
    total = table.sum(1, keepdims=True)
    logs = np.log((table + 0.5) / (total + 0.5 * 4000)) - np.log((table.sum(2, keepdims=True) + 0.5) / (total.sum() / ORDERS + 2000))
    logs[table.sum(2) == 0] = 0
    allowed = scripts / np.maximum(1, scripts.sum(0)) >= SCRIPT_SHARE
    return {"langs": langs, "logs": logs.astype(np.float32), "allowed": allowed}


def word_scores(model: dict, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of every word in every language."""
    total = np.zeros((len(points), len(model["langs"])), np.float32)
    for n, g in enumerate(grams(points)):
        total += model["logs"][n][g] * np.float32((0.2, 0.4, 1.0)[n])
    # from the first sign of a word to the boundary that closes it
    sums = np.add.reduceat(total, np.column_stack([starts, ends + 1]).ravel())[::2] if len(starts) else total[:0]
    allowed = model["allowed"][script_of(points[starts])]
    return np.where(allowed | ~allowed.any(1, keepdims=True), sums, np.float32(-1e4))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of every word; texts lie one after the other, `counts` words each."""
    n, langs = scores.shape
    labels = np.zeros(n, np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    begin = np.concatenate([[0], np.cumsum(alive)])
    number = np.min_scalar_type(max(langs - 1, 0))  # wide enough for every language
    came = np.zeros((n, langs), number)  # by step, then by text
    best = scores[first]
    final = np.zeros((len(order), langs), scores.dtype)
    own = np.arange(langs, dtype=number)
    for t in range(1, sizes[0]):
        k = alive[t]
        if k < len(best):
            final[k : len(best)] = best[k:]
            best = best[:k]
        top = best.argmax(1)
        jump = best[np.arange(k), top] - penalty
        stay = best >= jump[:, None]
        came[begin[t] : begin[t + 1]] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, jump[:, None]) + scores[first[:k] + t]
    final[: len(best)] = best
    now = final.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = alive[t]
        labels[first[:k] + t] = now[:k]
        if t:
            now[:k] = came[begin[t] : begin[t + 1]][np.arange(k), now[:k]]
    return labels


def identify(model: dict, texts: list[str | None], letter: np.ndarray) -> list[tuple]:
    """(language, score, spans) of every text; spans count words from 0 to before their end."""
    if not model["langs"]:
        return [("und", 0.0, [])] * len(texts)
    points, starts, ends, owner = split([t or "" for t in texts], letter)
    counts = np.bincount(owner, minlength=len(texts))
    labels = viterbi(word_scores(model, points, starts, ends), counts)
    weight = np.zeros((len(texts), len(model["langs"])))
    np.add.at(weight, (owner, labels), ends - starts)
    change = np.flatnonzero((labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])) + 1
    heads = np.concatenate([[0], change]) if len(labels) else change
    tails = np.concatenate([change, [len(labels)]])
    firsts = np.cumsum(counts) - counts
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(heads.tolist(), tails.tolist(), strict=False):
        o = owner[a]
        spans[o].append((int(a - firsts[o]), int(b - firsts[o]), model["langs"][labels[a]]))
    out = []
    for i, w in enumerate(weight):
        if not counts[i]:
            out.append(("und", 0.0, []))
        else:
            out.append((model["langs"][int(w.argmax())], float(w.max() / w.sum()), spans[i]))
    return out


def language(text: Column, model: dict) -> Column:
    """Struct of the language of most letters, its share of the letters, and the spans."""

    @F.pandas_udf(RESULT)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = letters()
        for texts in batches:
            out, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t or "")
                if size > TOGETHER:
                    out += identify(model, group, letter)
                    group, size = [], 0
            out += identify(model, group, letter) if group else []
            yield pd.DataFrame(
                {
                    "lang_pred": [o[0] for o in out],
                    "score": [o[1] for o in out],
                    "spans": [[{"start": a, "end": b, "lang": x} for a, b, x in o[2]] for o in out],
                }
            )

    return labelled(text)
