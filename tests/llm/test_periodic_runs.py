import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samplewright.llm import periodic_runs, queries

SF_DIR = "/root/testdata/sf0.001"


def slow_runs(w, least=12):
    """Every period by itself: maximal stretches of words that equal the word q before, with no smaller period."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_collapsed(w, runs):
    return b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=70), max_size=4), st.sampled_from([2, 5, 12]))
def test_two_letters(documents, least):
    assert periodic_runs.runs_of(documents, least) == [slow_runs(d, least) for d in documents]


def test_random_repeats(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", 7)
    rng = random.Random(5)
    documents = []
    for _ in range(250):
        w = []
        while len(w) < rng.randrange(1, 150):
            part = [rng.choice([b"x", b"y", b"z"][: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 16))]
            w += part * rng.randrange(1, 6)
        documents.append(w)
    got = periodic_runs.runs_of(documents)
    assert got == [slow_runs(d) for d in documents] and sum(map(len, got)) > 400
    for d, r in zip(documents, got, strict=True):
        assert periodic_runs.collapsed(d, r) == slow_collapsed(d, r)


@pytest.mark.parametrize("words", [[b"a"] * 12, [b"a"] * 11, [b"a"] * 5000, [b"a", b"b"] * 3000, list(map(str, range(99))), []])
def test_plain_cases(words):
    n = len(words)
    want = [(0, n, len(set(words)))] if n >= 12 and len(set(words)) < 3 else []
    assert periodic_runs.runs_of([words, words]) == [want, want]


def edited(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.length("text") < 6000).select("doc_id", "text")
    want = {}
    for r in docs.collect():
        w = edited(r.doc_id, r.text)
        runs = slow_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[r.doc_id] = (
            len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(slow_collapsed(w, runs)).hexdigest(),
        )
    got = {r.doc_id: tuple(r)[1:8] for r in queries.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert {d: got[d] for d in want} == want and sum(v[0] > 0 for v in want.values()) > 10


def test_words():
    text = "a\x0bb\x0cc\x1cd e f\x85g  h\r\ni"
    assert [w.decode() for w in periodic_runs.words_of(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_messy_rows_and_empty_tables(spark, messy, empty):
    docs = messy(["a b " * 20, "a b " * 20, "other"])
    got = periodic_runs.find_runs(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [tuple(x) for x in by[1].runs] == [(0, 40, 2)] and by[1].collapsed == "a b"
    assert by[100].n_words == 0 and by[100].runs == [] and by[100].collapsed == "" and by[103].n_words == 60_000
    assert [tuple(x) for x in by[103].runs] == [tuple(x) for x in periodic_runs.runs_of([docs.filter("doc_id = 103").first().text.encode().split()])[0]]
    assert periodic_runs.find_runs(empty).count() == 0
