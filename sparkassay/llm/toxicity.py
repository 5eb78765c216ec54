"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine and block-max inverted lists.

The examples are a bounded sample of the labelled rows: EXAMPLES ids per class in expectation, by a hash of the
id, and of these, in the order of another hash, as many as hold CHARACTERS code points together. Every word of
every example is a term. Its inverse document frequency is counted over all documents, and it is weighted by how
much it tells the classes apart (squared standard errors of its log odds, plus FLOOR), so that no word leaves the vectors.
An inverted index keeps examples in blocks of BLOCK: for a term, its postings block by block, and the largest weight in each; the
list of a common term is a full row of weights, read first. Blocks are read in the order of their upper bounds, for
many texts at once, until no unread block can hold a nearer neighbour, so the neighbours are exact. Their
votes, weighted by closeness, are calibrated on the examples themselves, each leaving itself out. Scoring covers
every row and every whole text, however long; only known words are kept of it.

Defined results: NULL counts as the empty text; a text without a known word gets the share of toxic
examples among such texts; labels that contradict each other and NULL labels or ids are not learned from; an
example whose id stands in several rows is its greatest text; without labels or documents every score is 0; ties between
neighbours go to the lower example number, which follows the id; repeated rows get equal scores; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse, repeat, tee

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import fold, release, settled, share

#: Bounds on the examples of each class, in rows (met in expectation, by hash) and in code points.
EXAMPLES, CHARACTERS = 2000, 8_000_000
BLOCK, NEIGHBOURS, FLOOR = 64, 15, 0.05
#: Postings of one term and block in an entry.
LANE = 4
#: Terms that stand in one of so many examples are common.
COMMON = 16
#: Queries that are read at once, and the entries of their terms; a query of more is read by itself.
TOGETHER, ENTRIES = 64, 200_000
#: Terms reported for a text, those of the largest weights.
EVIDENCE = 10
RESULT = "score double, predicted int, neighbours array<long>, evidence array<string>"
#: Results of different texts that a task remembers, besides those of one batch.
REMEMBERED = 10_000

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """All words in lower case, in any order. Most of what stands between white space is a word as it is."""
    pieces = (text or "").lower().split()
    return [*filter(str.isalpha, pieces), *_WORD.findall(" ".join(filterfalse(str.isalpha, pieces)))]


def words_of(text: str | None) -> Counter:
    return Counter(words_in(text))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Index:
    """Unit vectors of the examples as inverted lists by block. Postings are (example, term, weight), in any order."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int):
        # similar examples side by side, so that block bounds are tight: by their heaviest term
        lead = np.full(examples, terms)
        heavy = np.lexsort((term, -weight, example))
        at = np.flatnonzero(np.diff(example[heavy], prepend=-1))
        lead[example[heavy[at]]] = term[heavy[at]]
        self.order = np.argsort(lead, kind="stable")
        place = np.empty(examples, np.int64)
        place[self.order] = np.arange(examples)
        place = place[example]
        by = np.lexsort((place, term))
        self._lists(place[by].astype(np.int32), weight[by], np.bincount(term, minlength=terms))

    def __getstate__(self) -> tuple:
        # tasks are sent the postings alone
        return self.order.astype(np.int32), *self.sorted

    def __setstate__(self, state: tuple) -> None:
        self.order = state[0]
        self._lists(*state[1:])

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(example, term, weight), by term."""
        place, weight, holding = self.sorted
        return self.order[place], np.repeat(np.arange(len(holding)), holding), weight

    def _lists(self, place: np.ndarray, weight: np.ndarray, holding: np.ndarray) -> None:
        self.sorted = place, weight, holding
        examples, terms = len(self.order), len(holding)
        self.blocks = -(-examples // BLOCK)
        place, term = place.astype(np.int64), np.repeat(np.arange(terms), holding)
        # full rows hold at most COMMON times as many weights as there are postings
        often = (holding * COMMON >= examples) & (holding > 0)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.blocks * BLOCK))
        full = often[term]
        self.rows[self.row[term[full]], place[full]] = weight[full]
        place, weight, term = place[~full], weight[~full], term[~full]
        block = place // BLOCK
        first = (np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
        runs = np.flatnonzero(first)
        inside = np.arange(len(term)) - np.repeat(runs, np.diff(np.append(runs, len(term))))
        # an entry is a row of up to LANE postings of a term and block; the first of these names their largest weight
        lane = inside % LANE
        starts = np.flatnonzero(lane == 0)
        row = np.cumsum(lane == 0) - 1
        self.place = np.repeat(place[starts].astype(np.int32), LANE).reshape(-1, LANE)
        self.weight = np.zeros((len(starts), LANE))
        self.place[row, lane], self.weight[row, lane] = place, weight
        self.block, self.largest = block[starts], np.zeros(len(starts))
        self.largest[first[starts]] = np.maximum.reduceat(weight, runs) if len(term) else weight
        self.entry = np.searchsorted(term[starts], np.arange(terms + 1))

    def search(self, queries: Iterable[tuple[np.ndarray, np.ndarray]], k: int, without: Iterable[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """What `nearest` gives for each (terms, weights); up to TOGETHER queries are read at once."""
        some, rest = [], ENTRIES
        for query, left in zip(queries, repeat(-1) if without is None else without, strict=False):
            size = int((self.entry[query[0] + 1] - self.entry[query[0]]).sum())
            if some and (len(some) == TOGETHER or size > rest):
                yield from self._read(some, k)
                some, rest = [], ENTRIES
            some.append((*query, left))
            rest -= size
        if some:
            yield from self._read(some, k)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine as (cosine, example)."""
        return next(self.search([(terms, weights)], k, [without]))

    def _read(self, some: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> Iterator[list[tuple[float, int]]]:
        """Scores of the common terms are products. Weights are not negative, so these bound the cosines from below, and
        with the largest rest of a block from above."""
        n, width = len(some), self.blocks * BLOCK
        terms, weights = np.concatenate([q[0] for q in some]), np.concatenate([q[1] for q in some])
        query = np.repeat(np.arange(n), [len(q[0]) for q in some])
        common = self.row[terms]
        full = common >= 0
        heads = np.zeros((n, len(self.rows)))
        heads[query[full], common[full]] = weights[full]
        scores = heads @ self.rows
        terms, weights, query = terms[~full], weights[~full], query[~full]
        lists = self.entry[terms + 1] - self.entry[terms]
        entries, heavy, query = _ranges(self.entry[terms], lists), np.repeat(weights, lists), np.repeat(query, lists)
        # a cell is a block of a query
        cell = query * self.blocks + self.block[entries]
        rest = np.bincount(cell, heavy * self.largest[entries], minlength=n * self.blocks).reshape(n, self.blocks)
        bounds = scores.reshape(n, self.blocks, BLOCK).max(axis=2) + rest
        rank = np.empty((n, self.blocks), np.int64)
        np.put_along_axis(rank, np.argsort(-bounds, axis=1, kind="stable"), np.arange(self.blocks)[None], axis=1)
        least, read, step = self._least(scores, k), 0, 8
        while True:
            open_ = (rank >= read) & (bounds > 0) & (bounds >= least - 1e-12)
            if not open_.any():
                break
            now = np.flatnonzero((open_ & (rank < read + step)).ravel()[cell])
            here = entries[now]
            at = np.take(self.place, here, axis=0, mode="clip") + (query[now] * width)[:, None]
            more = np.take(self.weight, here, axis=0, mode="clip") * heavy[now, None]
            scores += np.bincount(at.ravel(), more.ravel(), minlength=n * width).reshape(n, width)
            read, step, least = read + step, 2 * step, self._least(scores, k)
        query, place = np.nonzero((scores > 0) & (scores >= least - 1e-12))
        # sums differ in their last digits with what is multiplied together
        near, example = scores[query, place].tolist(), self.order[place].tolist()
        ends = np.searchsorted(query, np.arange(n + 1)).tolist()
        for (_, _, left), a, b in zip(some, ends, ends[1:], strict=False):
            found = [(round(s, 12), i) for s, i in zip(near[a:b], example[a:b], strict=True) if i != left]
            yield sorted(found, key=lambda x: (-x[0], x[1]))[:k]

    @staticmethod
    def _least(scores: np.ndarray, k: int) -> np.ndarray:
        """A column of what the k nearest of each query reach at least; one of them may be left out."""
        if scores.shape[1] <= k + 1:
            return np.zeros((len(scores), 1))
        return np.partition(scores, -k - 1, axis=1)[:, [-k - 1]]


def vector(words: Counter, terms: dict[str, int], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of unit length; `value` is what a term is worth once."""
    at = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
    counts = np.fromiter(words.values(), np.int64, len(words))[at >= 0]
    at = at[at >= 0]
    raw = (1 + np.log(counts)) * value[at]
    return at, raw / np.sqrt(raw @ raw) if len(at) else raw


def vote(found: list[tuple[float, int]], toxic: np.ndarray) -> float:
    weights = np.array([1 / (1.05 - s) for s, _ in found])
    return float(weights @ toxic[[i for _, i in found]] / weights.sum())


def telling(example: np.ndarray, term: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """Standard errors by which a term's log odds differ between the classes."""
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    a = np.bincount(term, toxic[example], minlength=terms) + 0.5
    b = np.bincount(term, 1 - toxic[example], minlength=terms) + 0.5
    odds = np.log(a / (n1 - a + 1)) - np.log(b / (n0 - b + 1))
    return np.abs(odds) / np.sqrt(1 / a + 1 / b)


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> dict:
    """Monotone steps from votes to the weighted share of toxic examples (pooled neighbours)."""
    alone = votes < 0
    base = float((weight * toxic)[alone].sum() + 0.5) / float(weight[alone].sum() + 5)
    pools: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        if votes[i] < 0:
            continue
        pools.append([weight[i] * toxic[i], weight[i], votes[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, w, _ = pools.pop()
            pools[-1][0] += y
            pools[-1][1] += w
    ends = np.array([p[2] for p in pools])
    levels = np.array([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
    return {"base": base, "starts": ends, "levels": levels}


def calibrated(model: dict, v: float) -> float:
    if not len(model["starts"]):
        return model["base"]
    k = int(np.searchsorted(model["starts"], v + 1e-12, side="right")) - 1
    # a little of the vote itself keeps the order inside a step
    return float(np.clip(0.98 * model["levels"][max(k, 0)] + 0.02 * v, 0, 1))


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(doc_id, y, _text) of the chosen ids, settled, and the sizes of the classes outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id"), F.col("toxic"))
        .where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("y"), F.max("toxic").alias("_high"))
        .where("y = _high")
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return None, sizes
    chosen = known.where(
        ((F.col("y") == 1) & share(F.col("doc_id"), EXAMPLES, sizes[1], 3))
        | ((F.col("y") == 0) & share(F.col("doc_id"), EXAMPLES, sizes.get(0, 0), 4))
    ).select("doc_id", "y")
    # about twice EXAMPLES ids at most; rows that repeat an id are merged before they are shuffled
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    return settled(rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("_text").alias("_text")), "toxicity-examples"), sizes


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term. A task counts all its rows before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for same in pc.value_counts(batch["text"]).to_pylist():
                words = set(words_in(same["values"]))
                hits = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
                counts[hits[hits >= 0]] += same["counts"]
        at = np.flatnonzero(counts)
        term, n = np.append(at, -1), np.append(counts[at], rows)
        for a in range(0, len(term), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(term[a : a + 100_000], pa.int32()), pa.array(n[a : a + 100_000], pa.int64())], ["term", "n"])

    counted = docs.select(F.col("text")).mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted["term"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(len(terms), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> dict:
    """Learn from labels outside the held-out fold. To the driver come the ids and lengths of the chosen rows, the
    postings of examples within both bounds, and a count for each of their terms."""
    rows, sizes = labelled(docs, labels, folds, held)
    if rows is None:
        return {"base": 0.0}
    spark, lengths = rows.sparkSession, rows.select("doc_id", "y", F.length("_text").alias("n"), F.xxhash64("doc_id", F.lit(5)).alias("_h")).toPandas()
    lengths = lengths.sort_values(["_h", "doc_id"])
    inside = lengths[lengths.groupby("y")["n"].cumsum() <= CHARACTERS].sort_values("doc_id").reset_index(drop=True)
    if not (inside["y"] == 1).any():
        release(rows)
        return {"base": 0.0}
    numbered = spark.createDataFrame(pd.DataFrame({"doc_id": inside["doc_id"], "_example": np.arange(len(inside))}))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["_example"], pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int32()))],
                ["example", "words", "counts"],
            )

    postings = rows.join(F.broadcast(numbered), "doc_id").select("_example", "_text").mapInArrow(listed, "example long, words array<string>, counts array<int>").toArrow()
    release(rows)
    words, n = pc.list_flatten(postings["words"]), pc.list_flatten(postings["counts"]).to_numpy()
    example = np.repeat(postings["example"].to_numpy(), pc.list_value_length(postings["words"]).to_numpy())
    vocabulary = pc.unique(words)
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    term = pc.index_in(words, vocabulary).to_numpy().astype(np.int64)
    names = vocabulary.to_pylist()
    terms = {w: i for i, w in enumerate(names)}

    toxic = inside["y"].to_numpy(float)
    documents, holding = document_frequencies(docs, terms)
    value = (np.log((1 + documents) / (1 + holding)) + 1) * (FLOOR + telling(example, term, toxic, len(terms)) ** 2)
    raw = (1 + np.log(n)) * value[term]
    norms = np.sqrt(np.bincount(example, raw * raw, minlength=len(inside)))
    index = Index(example, term, raw / norms[example], len(inside), len(terms))
    model = {"terms": terms, "names": names, "value": value, "ids": inside["doc_id"].to_numpy(), "toxic": toxic, "index": index}
    # classes are sampled at different rates; the calibration weighs them by the share each stands for
    weight = np.where(toxic > 0, sizes[1] / max(1, toxic.sum()), sizes.get(0, 0) / max(1, (toxic == 0).sum()))
    return model | calibrate(own_votes(spark, index, toxic), toxic, weight)


def own_votes(spark, index: Index, toxic: np.ndarray) -> np.ndarray:
    """The vote of every example's neighbours, itself left out; -1 without neighbours."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        example, term, weight = index.postings()
        by = np.argsort(example, kind="stable")
        term, weight, first = term[by], weight[by], np.searchsorted(example[by], np.arange(len(toxic) + 1))
        for rows in batches:
            own = [(term[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]) for i in rows["id"]]
            near = index.search(own, NEIGHBOURS, rows["id"].tolist())
            votes = [vote(found, toxic) if found else -1.0 for found in near]
            yield pd.DataFrame({"id": rows["id"], "vote": votes})

    votes = spark.range(len(toxic)).mapInPandas(work, "id long, vote double").toPandas()
    return votes.sort_values("id")["vote"].to_numpy()


def toxicity(text: Column, model: dict) -> Column:
    """Struct of score, prediction, nearest examples and the heaviest terms."""

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        seen: dict[bytes, tuple] = {}
        nothing = (model["base"], int(model["base"] >= 0.5), [], [])

        def judged(at: np.ndarray, weights: np.ndarray, found: list[tuple[float, int]]) -> tuple:
            if not found:
                return nothing
            s = calibrated(model, vote(found, model["toxic"]))
            heaviest = at[np.lexsort((at, -weights))[:EVIDENCE]]
            return s, int(s >= 0.5), [int(model["ids"][i]) for _, i in found], [model["names"][t] for t in heaviest]

        for texts in batches:
            if "terms" not in model:
                yield pd.DataFrame([nothing] * len(texts), columns=["score", "predicted", "neighbours", "evidence"])
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            keys = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
            fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
            vectors, queries = tee(vector(words_of(t), model["terms"], model["value"]) for t in fresh.values())
            for k, v, found in zip(fresh, vectors, model["index"].search(queries, NEIGHBOURS), strict=True):
                seen[k] = judged(*v, found)
            out = [seen[k] for k in keys]
            yield pd.DataFrame(out, columns=["score", "predicted", "neighbours", "evidence"])

    return scored(text)
