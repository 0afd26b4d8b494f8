import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from samplewright.llm import multiset_hash as m
from samplewright.llm import queries

SF_DIR = "/root/testdata/sf0.001"

MASK = (1 << 64) - 1


def digits(text):
    """The same sums in plain Python."""
    pieces = re.findall(m.PIECE, text or "", re.ASCII)
    nine = xxhash.xxh64_intdigest((9).to_bytes(4, "little"), 42)
    two = lambda p: (xxhash.xxh64_intdigest(p.encode(), 42), xxhash.xxh64_intdigest(p.encode(), nine))
    h = [two(p) for p in pieces]
    whole = [two(x.strip(m.SPACE)) for x in (text or "").split("\n") if x.strip(m.SPACE)]
    lanes = [sum(x[f] >> k & m.TAKE for x in h) & MASK for f in (0, 1) for k in range(21)]
    wide = [sum(x[f] >> k & m.WIDE for x in whole) & m.WIDE for f in (0, 1) for k in (0, 32)]
    return "".join(f"{v:016x}" for v in lanes) + "".join(f"{v:08x}" for v in wide)


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    df = m.fingerprints(m.fingerprints(df, "a", "x"), "b", "y")
    return df.select(
        "a", "b", m.digits(F.col("x")).alias("dx"), m.digits(F.col("y")).alias("dy"), m.likeness(F.col("x"), F.col("y")).alias("like")
    ).collect()


def test_order_does_not_matter_and_content_does(spark):
    a = "One line here.\nAnother one. And a third with many words in it!\n"
    same, cut = "Another one. And a third with many words in it!\n\nOne line here.", "And a third with many words in it!\nOne line here.\nAnother one."
    rows = pairs(spark, [(a, same), (a, a + "x"), ("b b", "b\nb"), (None, " \n"), (a, cut)])
    assert [r.dx == r.dy for r in rows] == [True, False, False, True, False]
    assert [r.like == 1 for r in rows] == [True, False, False, True, True]  # the last has all its pieces in common
    assert all(r.dx == digits(r.a) and r.dy == digits(r.b) for r in rows)


def test_likeness_estimates_the_share_in_common(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(4))
    rows, share = [], []
    for common in (0, 20, 50, 80, 100) * 6:
        both = [line() for _ in range(common)]
        rows.append(tuple("\n".join(both + [line() for _ in range(100 - common)]) for _ in "ab"))
        share.append(common / 100)
    got = [r.like for r in pairs(spark, rows)]
    assert all(abs(g - s) < 0.45 for g, s in zip(got, share, strict=True))
    for s in set(share):
        near = [g for g, t in zip(got, share, strict=True) if t == s]
        assert sum(near) / len(near) == pytest.approx(s, abs=0.15)
    assert all(0 <= g <= 1 for g in got)


def test_paragraphs_are_inserted_and_deleted(spark):
    df = spark.createDataFrame([("a b c\nd e", "d e\nf g", "a b c\nd e\nd e\nf g")], "a string, b string, c string")
    for c in "abc":
        df = m.fingerprints(df, c, f"f{c}")
    fa, fb, fc = (F.col(f"f{c}") for c in "abc")
    row = df.select(
        (m.digits(m.combine(fa, fb)) == m.digits(fc)).alias("added"),
        (m.digits(m.combine(fc, fb, -1)) == m.digits(fa)).alias("taken"),
    ).first()
    assert row.added and row.taken


def test_order_inside_a_paragraph_and_breaks_count(spark):
    texts = ["a b c d\ne f g h", "a b c d e f g h", "e f g h a b c d", "One two. Three four.", "Three four. One two."]
    rows = pairs(spark, [(x, y) for x in texts for y in texts])
    assert all((r.dx == r.dy) == (r.a == r.b) for r in rows)
    shuffled = pairs(spark, [("x y.\n a b c\n\nz", "z\na b c \t\n x y.")])[0]
    assert shuffled.dx == shuffled.dy and shuffled.like == 1
    assert min(r.like for r in rows if r.a.split()[0] in "ae" and r.b.split()[0] in "ae") > 0.5


def test_lanes_do_not_carry(spark):
    n = (1 << 21) + 5
    odd, even = (1 << 63) - 1, 0x2AAAAAAAAAAAAAAA
    h = F.array_repeat(F.struct((F.col("id") + odd).alias("a"), (F.col("id") + even).alias("b")), n)
    df = spark.range(1).select(h.alias("h")).select(
        *[m._lane_total(F.col("h"), lambda x, f=f, k=k: F.shiftrightunsigned(x[f], k).bitwiseAND(F.lit(m.TAKE))).alias(f"{f}{k}") for f in "ab" for k in (0, 1)]
    )
    row = df.first()
    for f, bits in (("a", odd), ("b", even)):
        for k in (0, 1):
            want = sum((n * (bits >> k + s & 1) & m.LANE) << s for s in (0, 21, 42))
            assert row[f"{f}{k}"] == want


def expected(rows):
    """rows: (doc_id, text) by descending id."""
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), digits(text), digits(changed))
    return out


def test_query_against_plain_python(spark, documents):
    got = queries.op9_fingerprints(spark, SF_DIR).collect()
    want = expected([(r["doc_id"], r["text"]) for r in reversed(documents[1])])
    assert {r.doc_id: tuple(r)[1:5] for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 1500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_messy_rows_and_empty_tables(spark, messy, empty):
    docs = messy(["a b c d", "e f g h", "a b c d"])
    got = m.compare_edited(docs).collect()
    assert len(got) == docs.count()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[2] != prints[1] and prints[100] == prints[101] == prints[102]
    assert m.compare_edited(empty).count() == 0
    one = m.compare_edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
