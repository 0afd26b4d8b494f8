"""SimHash fingerprints, linked by a self-join of their binary trie.

The trie of the distinct fingerprints is cut into subtrees: all nodes at one depth, and deeper nodes where a
subtree is still large. Pairs of subtrees whose prefixes differ in no more bits than the budget are found by
equi-joins on flipped prefixes. Each pair is then walked down in one task, both subtrees together, adding up
differing bits and dropping pairs of nodes beyond the budget.

Copies share a fingerprint, so a group of copies is one row of the join however large it is. A task gets two
subtrees of at most ``subtree`` fingerprints each and returns a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from samplewright.llm.common import components
from samplewright.session import settle

SEED = 42
STEP = 4
NODE_PAIRS = 1 << 18  # pairs of trie nodes walked at a time
COMPARE = 64  # pairs of leaves below which two nodes are compared directly


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the shingles of three words; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < 3:
        return int.from_bytes(_majority([digest(join(words), SEED)]), "big")
    return int.from_bytes(
        _majority([digest(join(t), SEED) for t in zip(words, words[1:], words[2:], strict=False)]), "big"
    )


def _majority(digests: list[bytes]) -> bytes:
    hashes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:  # a histogram per byte is cheaper than 64 counters per hash
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ bits for k in range(8)])
    return np.packbits(2 * ones > len(hashes)).tobytes()


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.fromiter(map(fingerprint, batch), np.uint64, len(batch))
        yield pd.Series(found.view(np.int64))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component instead of all its links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        after = root.copy()
        for x in (u, v, root[u], root[v]):
            np.minimum.at(after, x, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def trie_links(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints (uint64) at most ``bits`` apart, as a spanning forest of their links.

    A trie node is a range of the sorted array. ``right`` is None for the pairs inside ``left``.
    """
    a = np.unique(left)
    b = a if right is None else np.unique(right)
    found_a, found_b, held = [], [], 0
    whole = np.array([[0, len(a), 0, len(b), 0]], np.int64)
    stack = [(0, whole)] if len(a) and len(b) else []
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > NODE_PAIRS:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (sizes <= COMPARE) | (depth == 64)
        if small.any():
            i, j = _inside(pairs[small], sizes[small])
            if right is None:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(a[i] ^ b[j]) <= bits
            if near.any():
                found_a.append(a[i[near]])
                found_b.append(b[j[near]])
                held += int(near.sum())
            if held > 1 << 20:
                x, y = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [x], [y], len(x)
        pairs = pairs[~small]
        if len(pairs):
            stack.append((depth + 1, _children(pairs, a, b, depth, bits, right is None)))
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _inside(pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all leaf pairs below small pairs of nodes."""
    which = np.repeat(np.arange(len(pairs)), sizes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (pairs[:, 3] - pairs[:, 2])[which]
    return pairs[which, 0] + k // width, pairs[which, 2] + k % width


def _children(pairs: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, bits: int, same: bool) -> np.ndarray:
    bit = np.uint64(1) << np.uint64(63 - depth)
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    alo, ahi, blo, bhi, diff = pairs.T
    amid = np.clip(np.searchsorted(a, (a[alo] & above) | bit), alo, ahi)
    bmid = np.clip(np.searchsorted(b, (b[blo] & above) | bit), blo, bhi)
    out = []
    for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
        la, ha = (alo, amid) if x == 0 else (amid, ahi)
        lb, hb = (blo, bmid) if y == 0 else (bmid, bhi)
        d = diff + (x != y)
        keep = (la < ha) & (lb < hb) & (d <= bits)
        if same:
            keep &= la <= lb
        out.append(np.stack([la, ha, lb, hb, d], axis=1)[keep])
    return np.concatenate(out)


def _mask(depth: int) -> int:
    """The top ``depth`` bits, as a signed long."""
    m = ((1 << depth) - 1) << (64 - depth)
    return m - (1 << 64) if m >= 1 << 63 else m


def subtrees(fps: DataFrame, subtree: int) -> tuple[DataFrame, int]:
    """(fp, depth, node) for every distinct fingerprint, and the depth where the subtrees start.

    The depth goes up in steps of four bits; a fingerprint is sent to the subtrees whose prefixes are near its own, 11 at
    four bits and 37 at eight.
    """
    n = fps.count()
    start = 0
    while n > (subtree // 16 if start == 0 else (subtree // 2) << start) and start < 60:
        start += STEP
    cut = fps.select("fp", F.lit(start).alias("depth"), F.col("fp").bitwiseAND(F.lit(_mask(start))).alias("node"))
    depth = start
    while depth < 64:
        large = cut.groupBy("depth", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > subtree)
        large = settle(large.filter(F.col("depth") == depth).select("depth", "node", F.lit(True).alias("large")))
        if large.isEmpty():
            break
        depth = min(64, depth + STEP)
        deeper = F.coalesce("large", F.lit(False))
        cut = settle(
            cut.join(large, ["depth", "node"], "left").select(
                "fp",
                F.when(deeper, depth).otherwise(F.col("depth")).alias("depth"),
                F.when(deeper, F.col("fp").bitwiseAND(F.lit(_mask(depth)))).otherwise(F.col("node")).alias("node"),
            )
        )
    return cut, start


def subtree_pairs(cut: DataFrame, start: int, bits: int) -> DataFrame:
    """(pair, a_depth, a, b_depth, b): subtrees whose prefixes differ in at most ``bits`` bits, each pair once."""
    leaves = settle(cut.select("depth", "node").distinct())
    deepest = leaves.agg(F.max("depth")).first()[0] or start

    def at(depth: int) -> tuple[Column, Column]:
        """The ancestor of a leaf that the walk stands on at a depth."""
        shallow = F.col("depth") <= depth
        return (
            F.when(shallow, F.col("depth")).otherwise(F.lit(depth)),
            F.when(shallow, F.col("node")).otherwise(F.col("node").bitwiseAND(F.lit(_mask(depth)))),
        )

    flips = [sum(1 << (63 - i) for i in c) for k in range(bits + 1) for c in combinations(range(start), k)]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    d, n = at(start)
    tops = leaves.select(d.alias("d"), n.alias("n")).distinct()
    near = tops.select(
        "d", "n", F.explode(F.array(*[F.col("n").bitwiseXOR(F.lit(f).cast("long")) for f in flips])).alias("m")
    )
    other = tops.select(F.col("d").alias("e"), F.col("n").alias("m"))
    pairs = near.join(other, "m").filter("n <= m").toDF("b", "a_depth", "a", "b_depth")
    for depth in range(start, deepest, STEP):
        (pd_, pn), (cd, cn) = at(depth), at(min(64, depth + STEP))
        steps = leaves.select(pd_.alias("pd"), pn.alias("pn"), cd.alias("cd"), cn.alias("cn")).distinct()
        left = steps.toDF("a_depth", "a", "x_depth", "x")
        right = steps.toDF("b_depth", "b", "y_depth", "y")
        both = pairs.join(left, ["a_depth", "a"]).join(right, ["b_depth", "b"])
        shared = F.least("x_depth", "y_depth")
        apart = F.when(shared == 0, 0).otherwise(
            F.bit_count(F.expr("(x ^ y) & shiftleft(-1L, 64 - least(x_depth, y_depth))"))
        )
        inside = (F.col("a_depth") == F.col("b_depth")) & (F.col("a") == F.col("b"))
        pairs = settle(
            both.filter((apart <= bits) & (~inside | (F.col("x") <= F.col("y")))).select(
                F.col("y").alias("b"), F.col("x_depth").alias("a_depth"), F.col("x").alias("a"),
                F.col("y_depth").alias("b_depth"),
            )
        )
    return settle(pairs.withColumn("pair", F.monotonically_increasing_id()))


def link_fingerprints(fps: DataFrame, bits: int = 2, subtree: int = 65_536) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at most ``bits`` apart do.

    ``fps`` has distinct values in ``fp``.
    """
    cut, start = subtrees(fps, subtree)
    pairs = subtree_pairs(cut, start, bits)
    sides = []
    for side, own in ((0, "a"), (1, "b")):
        of = pairs.filter("NOT (a = b AND a_depth = b_depth)") if side else pairs
        of = of.select("pair", F.col(f"{own}_depth").alias("depth"), F.col(own).alias("node"))
        sides.append(cut.join(of, ["depth", "node"]).select("pair", F.lit(side).cast("byte").alias("side"), "fp"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        fp, side = group["fp"].to_numpy().view(np.uint64), group["side"].to_numpy()
        a, b = trie_links(fp[side == 0], fp[side == 1] if side.any() else None, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sides[0].union(sides[1]).groupBy("pair").applyInPandas(walk, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2, subtree: int = 65_536
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links. NULL and empty texts have fingerprint
    0 and are linked like any other. Rows with a repeated id stay as they are; a NULL id is never the smallest
    unless a component has no other.
    """
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text).cast("string")).alias("fp")))
    first = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = settle(components(link_fingerprints(first.select("fp"), bits, subtree)))
    member = first.join(roots, first.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = settle(member.join(smallest, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
