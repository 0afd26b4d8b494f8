import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from samplewright.llm import packing, queries

SF_DIR = "/root/testdata/sf0.001"


def padded(counts, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in counts.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        counts = Counter(rng.randint(1, 14) for _ in range(40))
        k = rng.randint(1, 4)
        array = np.zeros(15, np.int64)
        for n, c in counts.items():
            array[n] = c
        ends = packing.boundaries(array, k)
        assert ends == sorted(set(ends)) and len(ends) <= k
        best = min(padded(counts, e) for r in range(1, k + 1) for e in combinations(sorted(counts), r) if e[-1] == max(counts))
        assert padded(counts, ends) == best
    assert packing.boundaries(np.zeros(5, np.int64), 3) == []


def check(rows, sizes, max_len, batch_tokens):
    """Every token is placed once, batches keep their budget and only the last of a bucket is not full."""
    assert Counter((r.doc_id, r.part) for r in rows) == Counter(
        (d, p) for d, n in sizes for p in range(max(1, math.ceil(n / max_len)))
    )
    assert sum(r.n_tokens for r in rows) == sum(n for _, n in sizes)
    batches = defaultdict(list)
    for r in rows:
        if r.n_tokens == 0:
            assert r.bucket_len is r.batch_id is r.slot is None
        else:
            assert r.n_tokens <= r.bucket_len
            batches[r.bucket_len, r.batch_id].append(r.slot)
    assert sorted(b for _, b in batches) == list(range(len(batches)))
    full = defaultdict(list)
    for (e, b), slots in sorted(batches.items(), key=lambda x: x[0][1]):
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, batch_tokens // e)
        full[e].append(len(slots) == max(1, batch_tokens // e))
    assert all(all(f[:-1]) for f in full.values())
    return sorted(full)


def test_query_packs_everything_optimally(spark, documents):
    sizes = [(r["doc_id"], len((r["text"] or "").split())) for r in documents[1]]
    rows = queries.op1_packing(spark, SF_DIR).collect()
    ends = check(rows, sizes, 2048, 65_536)
    counts = np.zeros(2049, np.int64)
    for r in rows:
        counts[r.n_tokens] += 1
    assert ends == packing.boundaries(counts, 8)


def test_many_slices_give_the_same_guarantees(spark, documents):
    df, rows = documents
    got = packing.pack(df, max_len=50, batch_tokens=200, buckets=3, slice_rows=7).collect()
    check(got, [(r["doc_id"], len((r["text"] or "").split())) for r in rows], 50, 200)


def test_messy_rows_and_empty_tables(messy, empty):
    docs = messy(["a b c", "a b c", "d"])
    rows = packing.pack(docs, max_len=100, batch_tokens=300).collect()
    sizes = [(r.doc_id, r.n) for r in docs.select("doc_id", packing.word_count(F.col("text")).alias("n")).collect()]
    want = Counter((d, p) for d, n in sizes for p in range(max(1, math.ceil(n / 100))))
    assert Counter((r.doc_id, r.part) for r in rows) == want
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs.filter("doc_id = 101")).collect()[0].batch_id is None
