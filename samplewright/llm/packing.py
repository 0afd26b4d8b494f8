"""Packing into length buckets whose boundaries minimise padding, and batches of a token budget inside each.

The histogram of lengths is the only thing the driver sees: one count for each length up to ``max_len``. Dynamic
programming over it finds the boundaries. Batches need a dense number of every sequence inside its bucket; a
bucket may hold most rows, so numbers come from slices of it, and only the slices' counts are added up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import settle


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds that minimise padding; ``counts[n]`` sequences have length n >= 1.

    best[k][j] is the least padded size of lengths up to the j-th with k buckets, the last ending there.
    """
    lengths = np.flatnonzero(counts[1:]) + 1
    if not len(lengths):
        return []
    c = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    m, k_max = len(lengths), min(buckets, len(lengths))
    best, cut = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(k_max):
        cost = np.tril(best[:m][None, :] + lengths[:, None] * (c[1:][:, None] - c[:m][None, :]))
        cost[np.triu_indices(m, 1)] = np.inf
        cut.append(cost.argmin(axis=1))
        best = np.concatenate([[np.inf], cost[np.arange(m), cut[-1]]])
    ends, j = [], m
    for at in reversed(cut):
        ends.append(int(lengths[j - 1]))
        j = int(at[j - 1])
        if j == 0:
            break
    return ends[::-1]


def word_count(text: Column) -> Column:
    """Words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    length: Column | None = None,
    buckets: int = 8,
    max_len: int = 2048,
    batch_tokens: int = 65_536,
    slice_rows: int = 20_000,
) -> DataFrame:
    """(doc_id, part, n_tokens, bucket_len, batch_id, slot): where every piece of every document goes.

    ``length`` is the number of tokens of a row (default: the words of ``text``). Longer documents are cut into
    parts of ``max_len`` tokens, so no token is lost; ``max_len`` bounds the histogram too. A batch holds
    ``max(1, batch_tokens // bucket_len)`` parts, each padded to ``bucket_len``. Batches are numbered densely over
    all buckets; only the last of a bucket may have empty slots. Documents without tokens have part 0 with no
    bucket. NULL ids and repeated rows are packed like others. Parts are dealt to slots by a hash of the row.
    """
    n = F.coalesce((word_count(F.col("text")) if length is None else length).cast("long"), F.lit(0))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.greatest(n, F.lit(0)).alias("n"))
    keyed = identified(sized).select(KEY, "row.doc_id", "row.n")
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("long")
    parts = keyed.select(KEY, "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = settle(
        parts.select(
            KEY, "doc_id", "part", F.least(F.col("n") - F.col("part") * max_len, F.lit(max_len)).alias("n_tokens")
        )
    )
    histogram = parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()  # max_len + 1 rows at most
    counts = np.zeros(max_len + 1, np.int64)
    for r in histogram:
        counts[r.n_tokens] = r.c
    ends = boundaries(counts, buckets)
    total = int(counts.sum())
    slices = max(1, -(-total // slice_rows))
    bucket = F.lit(None).cast("long")
    for e in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") > 0, bucket)
    order = F.xxhash64(KEY, "part")
    placed = parts.withColumns({"bucket_len": bucket, "_h": order}).withColumn("_slice", F.pmod("_h", F.lit(slices)))
    full = placed.filter("bucket_len IS NOT NULL")
    inside = full.withColumn("_in", F.row_number().over(W.partitionBy("bucket_len", "_slice").orderBy("_h", KEY, "part")) - 1)
    # Slices times buckets rows, one per 20,000 parts: the running sum goes bucket by bucket.
    sums = full.groupBy("bucket_len", "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("bucket_len").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("bucket_len", "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    per, first, used = F.lit(1).cast("long"), F.lit(0).cast("long"), 0
    for low, e in zip([0, *ends], ends, strict=False):
        hold = max(1, batch_tokens // e)
        per = F.when(F.col("bucket_len") == e, F.lit(hold).cast("long")).otherwise(per)
        first = F.when(F.col("bucket_len") == e, F.lit(used).cast("long")).otherwise(first)
        used += -(-int(counts[low + 1 : e + 1].sum()) // hold)
    at = F.col("_start") + F.col("_in")
    packed = inside.join(starts, ["bucket_len", "_slice"]).select(
        "doc_id", "part", "n_tokens", "bucket_len", (first + F.floor(at / per)).alias("batch_id"), (at % per).alias("slot")
    )
    none = F.lit(None).cast("long")
    empty = placed.filter("bucket_len IS NULL").select(
        "doc_id", "part", "n_tokens", none.alias("bucket_len"), none.alias("batch_id"), none.alias("slot")
    )
    return packed.union(empty)
