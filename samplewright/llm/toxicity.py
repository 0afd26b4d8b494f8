"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, their stems (the first letters of a word, so that unseen
compounds still count), pairs of neighbouring words, and pairs that skip one word. Each is hashed to one of
``2 ** BITS`` coordinates. Per-coordinate learning rates and an L1 penalty leave few weights that are not zero;
these are what is sent to the tasks that score, at most ``2 ** BITS`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import held_out

BITS = 20
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W_]+")
UNTAUGHT = -30.0  # bias of a model that has seen no labels
MEMO = 200_000  # words whose hashes a task remembers; more only cost time
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Memo(dict):
    """Word to the bytes of its hash and of its stems' hashes (zero: the word is shorter than the stem)."""

    def __missing__(self, w: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        stems = [xxhash.xxh64_digest(w[:n], n) if len(w) >= n else bytes(8) for n in STEMS]
        found = self[w] = xxhash.xxh64_digest(w, 0) + b"".join(stems)
        return found


class Hasher:
    """Hashed features of a text; remembers the hashes of words."""

    def __init__(self) -> None:
        self.memo = _Memo()

    def all(self, text: str | None) -> np.ndarray:
        """Coordinates of all features, repeats included."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        joined = b"".join(map(self.memo.__getitem__, words))
        h = np.frombuffer(joined, np.uint64).reshape(-1, 1 + len(STEMS))
        own, stems = h[:, 0], h[:, 1:]
        parts = [own, stems[stems != 0]]
        with np.errstate(over="ignore"):
            parts.append((own[:-1] * ODD[0] + own[1:] * ODD[1]) * ODD[3])
            parts.append((own[:-2] * ODD[2] + own[2:] * ODD[0] + ODD[1]) * ODD[3])
        return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


@dataclass
class Model:
    """Logistic weights that are not zero, by coordinate."""

    at: list[int]
    weight: list[float]
    bias: float

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[model.at] = model.weight
        self.bias, self.hasher = model.bias, Hasher()

    def __call__(self, text: str | None) -> float:
        found = self.hasher.all(text)
        hits = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[hits].sum(dtype=np.float64), -500, 500))))


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float
) -> Model:
    """FTRL-proximal (McMahan et al. 2013), one document at a time."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    bias = 0.0
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    at = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return Model(at.tolist(), w.tolist(), float(bias))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 8_000,
    updates: int = 40_000,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 5.0,
    l2: float = 0.01,
) -> Model:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold, in about ``updates`` updates.

    The rows are those whose ids hash lowest, so any further row changes the sample little. Only their ids are
    broadcast; their texts are picked in parallel and shuffled to one task, which returns the weights. A document with several labels is positive
    if one of them is; NULL labels and ids are passed over. Without labelled rows there is nothing to go by, and
    every score is close to 0.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(some), "_id").select(F.xxhash64("_id", "_text").alias("_order"), "_y", "_text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen, order, ys = Hasher(), [], [], []
        for batch in batches:
            seen += [hasher(t).astype(np.int32) for t in batch["_text"]]
            order += batch["_order"].tolist()
            ys += batch["_y"].tolist()
        if not seen:
            return
        by = np.argsort(np.array(order), kind="stable")
        epochs = min(20, -(-updates // len(seen)))
        model = ftrl([seen[i] for i in by], np.array(ys, float)[by], epochs, alpha, beta, l1, l2)
        yield pd.DataFrame({"at": [model.at], "weight": [model.weight], "bias": [model.bias]})

    got = rows.repartition(1).mapInPandas(learn, "at array<int>, weight array<double>, bias double").collect()
    return Model(*got[0]) if got else Model([], [], UNTAUGHT)


def score(model: Model, text: Column) -> Column:
    """Probability of the positive label for whole texts; NULL is read as an empty text."""

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in texts:
            yield pd.Series([scorer(t) for t in batch], dtype="float64")

    return probability(text.cast("string"))
