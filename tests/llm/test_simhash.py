from collections import Counter

import numpy as np
import pytest
import xxhash

from samplewright.llm import queries, simhash
from samplewright.llm.common import components

SF_DIR = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "a b c", "É é\xa0x y", "a\x0bb\tc\nd e f g " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("n,spread", [(1, 64), (300, 64), (400, 9), (200, 3)])
def test_trie_links_connect_what_all_pairs_connect(n, spread):
    rng = np.random.default_rng(n + spread)
    base = rng.integers(0, 1 << 63, 1).astype(np.uint64)
    flips = sum(np.uint64(1) << rng.integers(0, 64 if spread == 64 else spread, n).astype(np.uint64) for _ in range(3))
    values = np.unique(base ^ flips if spread < 64 else rng.integers(0, 1 << 63, n).astype(np.uint64) >> np.uint64(50))
    a, b = simhash.trie_links(values, None, 2)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    order = sorted(values.tolist())
    want = slow_components(order)
    at = {v: i for i, v in enumerate(order)}
    root = list(range(len(order)))
    for _ in order:
        for x, y in got:
            low = min(root[at[x]], root[at[y]])
            root[at[x]] = root[at[y]] = low
    assert root == want
    half = len(values) // 2
    left, right = values[:half], values[half:]
    a, b = simhash.trie_links(left, right, 2)
    linked = set(a.tolist()) | set(b.tolist())
    assert linked == {
        v for s, o in ((left, right), (right, left)) for v in s.tolist() if any((v ^ w).bit_count() <= 2 for w in o.tolist())
    }


@pytest.mark.parametrize("subtree", [4, 16, 1000])
def test_subtrees_of_any_size_give_the_same_links(spark, subtree):
    rng = np.random.default_rng(3)
    values = {int(v) for v in rng.integers(-(1 << 63), 1 << 63, 60)}
    values |= {int(v) ^ (1 << int(b)) for v in list(values)[:20] for b in rng.integers(0, 60, 2)}
    values |= {5, 4, 7, 5 | 1 << 20}
    order = sorted(values)
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in order], "fp long"), 2, subtree)
    roots = {r.node: r.root for r in components(links).collect()}
    mask = (1 << 64) - 1
    want = slow_components([v & mask for v in order])
    assert [roots.get(v, v) for v in order] == [order[w] for w in want]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want


def test_messy_rows_and_empty_tables(spark, messy, empty):
    docs = messy(["a b c d e f", "A B C D E F", "another text entirely here now"])
    rows = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert sum(rows.values()) == docs.count()
    by_id = {k[0]: k for k in rows if k[0] is not None}
    assert by_id[0][2] == by_id[1][2] == 0
    assert by_id[100] == (100, 0, 100) and by_id[101] == (101, 0, 100) and by_id[102] == (102, 0, 100)
    assert (None, 0, 100) in rows
    assert rows[by_id[104]] == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_query_against_brute_force(spark, documents):
    _, rows = documents
    prints = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(prints)
    want = {(r["doc_id"], f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, roots, strict=True)}
    got = queries.op6_near_duplicates(spark, SF_DIR).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
