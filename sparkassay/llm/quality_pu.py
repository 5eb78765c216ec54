"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled web text by the non-negative risk
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])
so that no text has to be trusted as bad. The class prior is estimated from the labelled rows of
the learning folds. Features are shape statistics of a whole text. Training rows are a sample of
bounded size (POSITIVES, UNLABELLED), chosen by a hash of the id; scoring covers every row.

Defined results: NULL counts as the empty text; labels that contradict each other for one document
are not trusted; without trusted positives every score is the prior (0.5 without any labels);
repeated rows get equal scores; extra columns stay with their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import fold, share
from sparkassay.llm.repetition import SPACES, SYMBOLS, repeated_windows, words_of

#: Bounds of the training sample, in rows (met in expectation, by hash).
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 512, 0.01

_DIGIT, _UPPER, _STOP = re.compile(r"[0-9]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[.?!](?:\s|$)")
_MARK = re.compile(r"[!?]")
FEATURES = 16


def features(text: str | None) -> list[float]:
    """Shape of a text: length, characters, repetition, lines, sentences."""
    text = text or ""
    words, chars = words_of(text), max(1, len(text))
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    triples = repeated_windows(ids, len(numbers)).mean() if n >= 3 else 0.0
    lines = [x for x in text.split("\n") if x]
    same = np.bincount(ids).max() / n
    return [
        1.0,
        np.log1p(n),
        (chars - sum(text.count(c) for c in SPACES)) / n,
        sum(text.count(c) for c in SYMBOLS) / n,
        len(_UPPER.findall(text)) / chars * 10,
        len(_DIGIT.findall(text)) / chars * 10,
        len(_MARK.findall(text)) / n,
        len(_STOP.findall(text)) / n * 10,
        len(numbers) / n,
        len(numbers) / np.sqrt(n),
        float(triples),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        float(same),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        text.count(",") / n * 10,
    ]


def _vectors(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def taken(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return taken(text)


def forward(model: dict, x: np.ndarray) -> np.ndarray:
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return np.tanh(x @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> dict:
    """Minimise the non-negative risk with the logistic loss by Adam; where the negative part of the
    risk falls below zero, its gradient is turned round."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    model = {"mean": mean, "scale": scale}
    k = both.shape[1]
    w = {
        "w1": rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        "b2": np.zeros(1),
    }
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    steps = max(1, len(both) // BATCH)
    t = 0
    for _ in range(EPOCHS):
        for _ in range(steps):
            t += 1
            x = np.vstack([p[rng.integers(0, len(p), BATCH // 2)], u[rng.integers(0, len(u), BATCH // 2)]])
            h = np.tanh(x @ w["w1"] + w["b1"])
            z = h @ w["w2"] + w["b2"]
            s, half = sigmoid(z), BATCH // 2
            loss = np.logaddexp(0, z)  # of calling a row negative
            negative = loss[half:].mean() - prior * loss[:half].mean()
            g = np.zeros(BATCH)
            if negative >= 0:
                g[:half] = prior * (s[:half] - 1) / half - prior * s[:half] / half
                g[half:] = s[half:] / half
            else:
                g[:half] = prior * s[:half] / half
                g[half:] = -s[half:] / half
            back = np.outer(g, w["w2"]) * (1 - h * h)
            grads = {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ g, "b2": np.array([g.sum()])}
            for n, d in grads.items():
                d = d + 1e-4 * w[n]
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.999 * second[n] + 0.001 * d * d
                w[n] = w[n] - RATE * first[n] / (1 - 0.9**t) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
    return model | w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> dict:
    """Learn from labels outside the held-out fold. What comes to the driver is the feature matrix
    of the bounded sample and two counts."""
    trusted = (
        labels.select(F.col("doc_id"), F.col("quality"))
        .where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
    )
    n, good = trusted.agg(F.count("*"), F.sum("low")).first()
    if not good:
        return {"prior": 0.5 if not n else 0.0}
    prior = min(max(good / n, 0.02), 0.98)
    texts = docs.select(F.col("doc_id"), F.col("text")).where("doc_id IS NOT NULL")
    chosen = trusted.where((F.col("low") == 1) & share(F.col("doc_id"), POSITIVES, good, 1)).select("doc_id")
    # at most about POSITIVES ids of eight bytes
    positive = texts.join(F.broadcast(chosen), "doc_id")
    unlabelled = texts.where(share(F.col("doc_id"), UNLABELLED, docs.count(), 2))
    rows = (
        positive.select(F.lit(1).alias("y"), "doc_id", "text")
        .unionByName(unlabelled.select(F.lit(0).alias("y"), "doc_id", "text"))
        .select("y", "doc_id", _vectors(F.col("text")).alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r["y"], r["doc_id"], r["x"]))
    y, x = np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    if not (y == 1).any() or not (y == 0).any():
        return {"prior": prior}
    return train(x[y == 1], x[y == 0], prior) | {"prior": prior}


def quality_score(text: Column, model: dict) -> Column:
    """Posterior that a text is good, between 0 and 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if "w1" not in model:
                yield pd.Series(np.full(len(texts), model["prior"]))
                continue
            x = np.array([features(t) for t in texts], float).reshape(len(texts), FEATURES)
            yield pd.Series(sigmoid(forward(model, x)))

    return scored(text)
