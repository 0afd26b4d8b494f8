"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Filters two, three and four bytes wide slide over each window, every
filter keeps its maximum, and a softmax layer turns the maxima into probabilities; a document's are the mean of
its windows'. A filter over one-hot bytes is a table of weights per byte and position, so the layer is applied by
lookups, two neighbouring bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import held_out

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
BLOCK = 64  # windows looked up at a time, so that what is looked up stays in the processor's cache
UNKNOWN = "und"


def windows(text: str | None) -> np.ndarray:
    """Bytes of the whole text in rows of ``WINDOW``, the last filled up with zeros."""
    data = (text or "").lower().encode("utf-8", "replace")
    rows = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    """``tables[w][j, byte, filter]``: weight of a byte at place j under a filter w wide."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def maxima(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of every filter in every window."""
        if self.pairs is None:
            two, three, four = self.tables
            pair = lambda t, i: (t[i][:, None] + t[i + 1][None, :]).reshape(1 << 16, -1)
            first = np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], axis=1)
            third = np.repeat(three[2], 256, axis=0)
            self.pairs = first.astype(np.float32), np.concatenate([third, pair(four, 2)], axis=1).astype(np.float32)
        first, later = self.pairs
        out = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
        for i in range(0, len(rows), BLOCK):
            x = np.zeros((WINDOW + 3, len(rows[i : i + BLOCK])), np.int64)
            x[:WINDOW] = rows[i : i + BLOCK].T
            two = x[:-1] * 256 + x[1:]
            act = first[two[:WINDOW]]
            act[:, :, FILTERS:] += later[two[2 : WINDOW + 2]]
            out[i : i + BLOCK] = act.max(axis=0)
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.maxima(rows) + self.bias, 0)
        return _softmax(hidden @ self.dense + self.offset)

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its probability; no language is told of a text without bytes."""
        langs, scores, held, kept = [], [], [], 0

        def flush() -> None:
            nonlocal held, kept
            rows = np.concatenate(held)
            p = self.probabilities(rows)
            ends = np.cumsum([len(h) for h in held])
            for h, end in zip(held, ends, strict=True):
                mean = p[end - len(h) : end].mean(axis=0) if len(h) else np.zeros(len(self.langs))
                langs.append(self.langs[int(mean.argmax())] if len(h) else UNKNOWN)
                scores.append(float(min(1.0, mean.max())))
            held, kept = [], 0

        for t in texts:
            held.append(windows(t))
            kept += len(held[-1])
            if kept > 20_000:
                flush()
        if held:
            flush()
        return langs, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01) -> Network:
    """Adam on batches of windows; the gradient of a maximum goes to where it was found."""
    rng = np.random.default_rng(7)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    width = len(WIDTHS) * FILTERS
    net = Network(
        langs, tables, np.zeros(width, np.float32), rng.normal(0, 0.3, (width, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    params = [*net.tables, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    padded = np.concatenate([rows, np.zeros((len(rows), max(WIDTHS) - 1), np.uint8)], axis=1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in np.array_split(order, max(1, len(rows) // 64)):
            x = padded[at]
            grads = _gradients(net, x, y[at])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, places, top = len(x), [], []
    for w, table in zip(WIDTHS, net.tables, strict=True):
        act = sum(table[j][x[:, j : j + WINDOW]] for j in range(w))
        places.append(act.argmax(axis=1))
        top.append(np.take_along_axis(act, places[-1][:, None, :], axis=1)[:, 0])
    before = np.concatenate(top, axis=1) + net.bias
    hidden = np.maximum(before, 0)
    p = _softmax(hidden @ net.dense + net.offset)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.dense.T) * (before > 0)
    out = []
    for k, (w, table) in enumerate(zip(WIDTHS, net.tables, strict=True)):
        g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(w):
            bytes_ = np.take_along_axis(x, places[k] + j, axis=1)
            np.add.at(g[j], (bytes_, np.broadcast_to(np.arange(FILTERS), bytes_.shape)), part)
        out.append(g)
    return [*out, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_docs: int = 4_000,
    windows_per_doc: int = 4,
) -> Network | None:
    """Learn from at most ``max_docs`` documents outside the held-out fold and as many windows of each.

    The documents are those whose ids hash lowest; their windows lie evenly over the text. They are picked in
    parallel and shuffled to one task, which returns the weights. Rows with a NULL id or language and texts without a letter are passed over; None if
    nothing is left.
    """
    known = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).alias("_lang"))
    known = known.filter("_lang IS NOT NULL AND _id IS NOT NULL").filter(~held_out(F.col("_id")))
    ids = known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = known.join(F.broadcast(ids), "_id").filter(F.col("_text").rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64("_id", "_text", "_lang").alias("_order"), "_text", F.col("_lang").cast("string"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[tuple[int, str, np.ndarray]] = []
        for batch in batches:
            for o, t, lang_ in zip(batch["_order"], batch["_text"], batch["_lang"], strict=True):
                cut = windows(t)
                at = np.unique(np.linspace(0, len(cut) - 1, windows_per_doc).astype(int))
                seen.append((o, lang_, cut[at]))
        if not seen:
            return
        seen.sort(key=lambda s: (s[0], s[1]))
        langs = sorted({s[1] for s in seen})
        y = np.concatenate([np.full(len(w), langs.index(name)) for _, name, w in seen])
        net = train(np.concatenate([w for _, _, w in seen]), y, langs)
        flat = np.concatenate([p.ravel() for p in (*net.tables, net.bias, net.dense, net.offset)])
        yield pd.DataFrame({"langs": [langs], "flat": [flat.astype(float)]})

    got = rows.repartition(1).mapInPandas(learn, "langs array<string>, flat array<double>").collect()
    if not got:
        return None
    langs, flat = list(got[0].langs), np.array(got[0].flat, np.float32)
    width = len(WIDTHS) * FILTERS
    shapes = [(w, 256, FILTERS) for w in WIDTHS] + [(width,), (width, len(langs)), (len(langs),)]
    parts, at = [], 0
    for s in shapes:
        size = int(np.prod(s))
        parts.append(flat[at : at + size].reshape(s))
        at += size
    return Network(langs, parts[:3], *parts[3:])


def identify(net: Network | None, docs: DataFrame, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of every whole text and its probability (0 to 1).

    Texts that are NULL or without a letter are ``und`` with score 0; so is everything if nothing was learned.
    """

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = net.batch(batch.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    has = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.withColumns({name: F.lit(UNKNOWN), score: F.lit(0.0)})
    found = predict(F.col(text).cast("string"))
    out = docs.select("*", has.alias("__has"), found.alias("__found"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (name, score)],
        F.when(F.col("__has"), F.col("__found.lang")).otherwise(UNKNOWN).alias(name),
        F.when(F.col("__has"), F.col("__found.score")).otherwise(0.0).alias(score),
    )
