import random

import numpy as np

from samplewright.llm import decontamination as d


def brute(docs, items, threshold=0.8):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [d.words(t)] for i in range(len(w) - 4)}
    own = {k: grams(t) for k, t in docs if t is not None}
    out = set()
    for i, t in items:
        q = grams(t)
        out |= {(k, i, len(q & g), len(q)) for k, g in own.items() if q and len(q & g) >= threshold * len(q)}
    return out


def sentence(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def test_planted_items_of_all_sizes_are_found(spark):
    rng = random.Random(5)
    items, docs = [], []
    for i in range(60):
        words = sentence(rng, rng.choice([5, 6, 12, 13, 30, 68, 69, 200, 700]))
        items.append((i, " ".join(words)))
        body = sentence(rng, rng.choice([0, 3, 500, 4000]))
        at = rng.randint(0, len(body))
        planted = list(words)
        if i % 3 == 0:
            planted[rng.randrange(len(planted))] = "changed"
        parts = [planted] if i % 4 else [planted[: len(planted) // 2], sentence(rng, 90), planted[len(planted) // 2 :]]
        docs.append((1000 + i, " ".join(body[:at] + sum(parts, []) + body[at:]).upper()))
    docs += [(1, None), (2, ""), (3, "four words are few")]
    items += [(90, "four words are few"), (91, None), (92, items[0][1])]
    got = d.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == want
    assert len(want) > 40


def filters_of(keys):
    """The filters of (width, permutation, key) rows, made without Spark."""
    packed = {}
    for width, permutation in sorted({k[:2] for k in keys}):
        own = np.array([k[2] for k in keys if k[:2] == (width, permutation)], np.uint64)
        bits = d._filter_bits(width)
        maps = np.zeros((2, 1 << bits), bool)
        for probe in (0, 1):
            maps[probe, (own >> np.uint64(64 - bits * (probe + 1))) & np.uint64((1 << bits) - 1)] = True
        packed[width, permutation] = [np.packbits(m).tobytes() for m in maps]
    return d.Filters(packed)


def test_no_short_item_is_missed():
    """2,000 verbatim copies of each size; by minima of windows of eight 1.4 % of the items of one shingle are missed."""
    memo = d._Memo()
    for size in (5, 6, 8, 12):
        items = [[f"s{size}i{i}w{j}" for j in range(size)] for i in range(2_000)]
        keys = [{(d.EXACT, 0, int(x)) for x in d._shingle_hashes(w, memo)} for w in items]
        assert all(d._minima(w, memo) is None for w in items)
        docs = [[f"d{i}a{j}" for j in range(40)] + w + [f"d{i}b{j}" for j in range(40)] for i, w in enumerate(items)]
        found = filters_of(set().union(*keys)).document_keys([d._shingle_hashes(w, memo) for w in docs])
        hits = {}
        for doc, width, permutation, key in zip(found["doc"], found["width"], found["permutation"], found["key"].to_numpy().view(np.uint64), strict=True):
            hits.setdefault(doc, set()).add((width, permutation, int(key)))
        assert all(keys[i] <= hits[i] for i in range(2_000)), size


def test_many_documents_and_items_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(sentence(rng, 20))) for i in range(25)] + [(100 + i, "the same nine words stand in many an item") for i in range(300)]
    docs = [(i, " ".join(sentence(rng, 100)) + " " + items[i % 26][1]) for i in range(260)]
    got = d.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    found = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()]
    assert len(found) == len(set(found)) == 250 + 10 * 300
    assert set(found) == brute(docs, items)


def test_filters_of_spark_are_those_of_their_keys(spark):
    rng = random.Random(7)
    keys = {(w, p, rng.getrandbits(64)) for w, p in [(d.EXACT, 0), (d.ALL, 0), (16, 3), (64, 31)] for _ in range(200)}
    rows = [(w, p, k - (1 << 64) if k >> 63 else k) for w, p, k in keys]
    made = d.item_filters(spark.createDataFrame(rows, "width int, permutation int, key long"))
    assert made.packed == filters_of(keys).packed
    assert d.item_filters(spark.createDataFrame([], "width int, permutation int, key long")).packed == {}


def test_minima_of_windows_are_minima_of_their_halves():
    memo = d._Memo()
    long, short = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(15)]
    (wide, lows), (narrow, others) = d._minima(long, memo), d._minima(short, memo)
    assert (wide, narrow) == (64, 16)
    hashes = d._shingle_hashes(long, memo)
    assert int(lows[0]) == int((hashes * d.MULTIPLIERS[0] + d.ADDENDS[0]).min())
    keys = {(w, i, int(x)) for w, xs in ((wide, lows), (narrow, others)) for i, x in enumerate(xs)}
    found = filters_of(keys).document_keys([np.empty(0, np.uint64), hashes])
    got = {(w, p, int(np.array(k).view(np.uint64))) for w, p, k in zip(found["width"], found["permutation"], found["key"], strict=True)}
    assert set(found["doc"]) == {1}
    assert {(64, i, int(x)) for i, x in enumerate(lows)} <= got


def test_ids_keep_their_types(spark):
    docs = spark.createDataFrame([("d/1", "one two three four five six"), ("x", "nothing"), (None, "one two three four five six")], "doc_id string, text string")
    items = spark.createDataFrame([("task-7", "ONE two three four five"), ("task-8", "two, three, four, five, six")], "item_id string, text string")
    got = {tuple(r) for r in d.contained_items(docs, items).collect()}
    assert got == {("d/1", "task-7", 1, 1, 1.0), ("d/1", "task-8", 1, 1, 1.0)}


def test_messy_rows_and_empty_tables(spark, messy, empty):
    item = "seven plain words stand in this item"
    docs = messy([f"before {item} after", "b", "c"])
    items = spark.createDataFrame([(1, item, "z"), (1, item, "z"), (None, item, "z"), (2, None, "z")], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in d.contained_items(docs, items).collect()]
    assert got == [(0, 1, 3, 3, 1.0)] * 2
    assert d.contained_items(empty, items).count() == 0
    assert d.contained_items(docs, items.limit(0)).count() == 0
