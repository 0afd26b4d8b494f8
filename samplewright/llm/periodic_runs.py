"""Runs of words that repeat with a period: maximal stretches whose words recur every ``q`` words.

The words of a block of documents are concatenated, each document closed by an end of its own, and get an enhanced
suffix array: ranks by prefix doubling, their inverse, and the longest common prefixes of neighbours. Of each LCP
interval of depth ``d`` all children but the largest are tried: a suffix ``i`` with ``ISA[i + d]`` or ``ISA[i - d]`` in
the interval begins or continues a square of two equal halves of ``d`` words. Squares that cannot be shifted right
(branching tandem repeats) are rotated left as far as their words agree, which gives the maximal run, and equal
stretches are merged under their smallest period. Intervals are ranges of positions; no tree is built.

Everything is per document, so Spark only deals out documents; a block holds ``BLOCK_WORDS`` words or one document, and
memory grows with the block, not with the repeats: intervals are worked off in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
BLOCK_WORDS = 1 << 19
SLICE = 1 << 20  # suffixes of smaller children looked at together


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space (blank, and 0x09 to 0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _double(rank: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
    """Ranks of blocks of ``2 * width`` words from those of ``width``; ``left`` words remain up to the document's end."""
    n = len(rank)
    second = np.full(n, -1, np.int64)
    inside = np.flatnonzero(left > width)
    second[inside] = rank[inside + width]
    return np.unique(rank.astype(np.int64) * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int32)


def _left(sizes: np.ndarray) -> np.ndarray:
    """Of each word, how many there are from it to the end of its document, itself included."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))


def _first_ranks(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks of single words inside their document; no two documents share one."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    return np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int32)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that the stretches from ``a`` and ``b`` on, or those that end before them, have in common.

    ``levels[k]`` ranks blocks of ``2 ** k`` words, and no block that runs over the end of a document equals another.
    """
    n = len(levels[0])
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = (a - got - step, b - got - step) if back else (a + got, b + got)
        ok = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        got += step * ok
    return got


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the nearest smaller entries before and after it."""
    n = len(lcp)
    before, after, stack = [-1] * n, [n] * n, []
    for i, v in enumerate(lcp.tolist()):
        while stack and stack[-1][0] > v:
            after[stack.pop()[1]] = i
        if stack:
            top = stack[-1]
            before[i] = before[top[1]] if top[0] == v else top[1]
        stack.append((v, i))
    # Equal values hide the smaller one behind them on the right.
    value = lcp.tolist()
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n and value[j] == value[i]:
            after[i] = after[j]
    return np.array(before, np.int64), np.array(after, np.int64)


def _squares(levels: list[np.ndarray], sa: np.ndarray, isa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of all branching tandem repeats."""
    n = len(sa)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = _common(levels, sa[:-1], sa[1:])
    before, after = _bounds(lcp)
    at = np.flatnonzero(lcp > 0)
    low, high, depth = before[at], after[at] - 1, lcp[at]
    # A child lies between two neighbouring entries of its interval's depth; the interval is SA[low .. high].
    order = np.lexsort((at, depth, low))
    at, low, high, depth = at[order], low[order], high[order], depth[order]
    same = np.zeros(len(at), bool)
    same[1:] = (low[1:] == low[:-1]) & (depth[1:] == depth[:-1]) & (high[1:] == high[:-1])
    first = np.flatnonzero(~same)
    own = np.cumsum(~same) - 1
    start = np.concatenate([np.where(same, 0, low), at])  # children before each entry, and the last of each interval
    start[: len(at)][same] = at[np.flatnonzero(same) - 1]
    last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
    begin = np.concatenate([start[: len(at)], at[last]])
    end = np.concatenate([at, high[last] + 1])
    interval = np.concatenate([own, np.arange(len(first))])
    size = end - begin
    order = np.lexsort((size, interval))
    largest = np.zeros(len(order), bool)
    largest[order[np.append(interval[order][1:] != interval[order][:-1], True)] if len(order) else []] = True
    begin, size, interval = begin[~largest], size[~largest], interval[~largest]
    lo, hi, d = low[first], high[first], depth[first]
    found = []
    cuts = np.searchsorted(np.cumsum(size), np.arange(SLICE, int(size.sum()) + SLICE, SLICE), side="left") + 1
    for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True) if len(size) else ():
        s, k = size[a:b], np.repeat(interval[a:b], size[a:b])
        if not len(s):
            continue
        i = sa[np.repeat(begin[a:b], s) + np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)]
        for here, other in ((i, i + d[k]), (i - d[k], i - d[k])):
            x = other if other is not here else here
            ok = (x >= 0) & (x < n)
            ok[ok] = (isa[x[ok]] >= lo[k[ok]]) & (isa[x[ok]] <= hi[k[ok]])
            found.append(np.stack([here[ok], d[k[ok]]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    start, half = both
    branching = _common(levels, start, start + half) == half
    return start[branching], half[branching]


def runs_of(documents: list[list[bytes]], least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(w) for w in documents], np.int64)
    known = np.flatnonzero(sizes >= least)
    if not len(known):
        return out
    ids = pd.factorize(np.array([w for k in known for w in documents[k]], object))[0].astype(np.int64)
    sizes = sizes[known]
    rank = _first_ranks(ids, sizes)
    # A run of ``least`` words or two periods repeats a block of half as many words. Documents without one are done.
    width = 1
    while 2 * width <= (least + 1) // 2:
        rank, width = _double(rank, width, _left(sizes)), 2 * width
    twice = np.bincount(rank)[rank] > 1
    some = np.add.reduceat(twice, np.cumsum(sizes) - sizes) > 0
    ids, known, sizes = ids[np.repeat(some, sizes)], known[some], sizes[some]
    if not len(known):
        return out
    left = _left(sizes)
    levels = [_first_ranks(ids, sizes)]
    while int(levels[-1].max()) + 1 < len(ids):
        levels.append(_double(levels[-1], 1 << (len(levels) - 1), left))
    isa = levels[-1].astype(np.int64)
    sa = np.empty(len(ids), np.int64)
    sa[isa] = np.arange(len(ids))
    start, period = _squares(levels, sa, isa)
    back = _common(levels, start, start + period, back=True)
    start, end = start - back, start + 2 * period
    long = end - start >= least
    rows = np.unique(np.stack([start[long], end[long], period[long]], axis=1), axis=0)
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]  # the smallest period of a stretch
    firsts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(firsts, rows[:, 0], side="right") - 1
    for k, (s, e, q) in zip(doc.tolist(), rows.tolist(), strict=True):
        out[known[k]].append((s - int(firsts[k]), e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, runs, collapsed).

    ``runs`` lists (start, length, period) of every maximal stretch with that smallest period, at least ``least`` words
    and two periods long, by start, then period; words count from 0. ``collapsed`` is the text without the words that a
    run contains after its first period, joined by single blanks. NULL and empty texts have no words, no runs and an
    empty collapsed text; repeated rows and NULL ids are rows like any other; an empty table gives no rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, words, first = 0, [], 0
            for i, t in enumerate(batch["text"]):
                words.append(words_of(t if isinstance(t, str) else None))
                held += len(words[-1])
                if held >= BLOCK_WORDS or i + 1 == len(batch):
                    found = runs_of(words, least)
                    yield pd.DataFrame(
                        {
                            "doc_id": batch["doc_id"].iloc[first : i + 1],
                            "n_words": [len(w) for w in words],
                            "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found],
                            "collapsed": [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, found, strict=True)],
                        }
                    )
                    held, words, first = 0, [], i + 1

    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return some.mapInPandas(rows, schema)
