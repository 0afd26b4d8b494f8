"""Homomorphic multiset fingerprints of documents: sums of wide vectors hashed from their paragraphs.

A paragraph is a line with anything but white space, without the white space around it. Two 64-bit hashes of a whole
paragraph give four numbers of 32 bits, summed over the paragraphs modulo ``2 ** 32``: they tell texts apart that differ
in a paragraph's order of words, or in where paragraphs end. Besides, a paragraph is hashed in pieces, runs of at most
four words of a sentence, so that an edit changes a part of its vector only. The two hashes of a piece are 126 bits, summed
modulo ``2 ** 21`` (three lanes in a long). Order of paragraphs therefore does not matter, and a paragraph is inserted
or deleted by adding or subtracting its vector.

The bits serve for likeness: ``2 * ones - n`` is a sum of random signs, so the squared distance of two
fingerprints, averaged over the lanes, estimates how many pieces they do not share (Alon, Matias and Szegedy). Sums of
lanes are taken modulo ``2 ** 21``, so likeness holds for texts of fewer than two million pieces; equality holds for all.

Column expressions only; a row needs no other row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import shuffle_partitions

PIECE = r"(?:\S*[^\s.!?][ \t]+){0,3}\S+"
SPACE = " \t\n\x0b\f\r"  # what white space is in PIECE
LANE_BITS = 21
LANE = (1 << LANE_BITS) - 1
TAKE = 1 | 1 << LANE_BITS | 1 << 2 * LANE_BITS  # one bit of each of the three lanes of a long
WORDS = 2 * LANE_BITS  # longs that hold the 126 lanes
TOP = TAKE << (LANE_BITS - 1)  # the highest bit of each lane
WIDE = (1 << 32) - 1
SAFE = 1 << 20  # so many pieces cannot fill a lane


def _hashed(texts: Column) -> Column:
    return F.transform(texts, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(9), p).alias("b")))


def piece_hashes(text: Column) -> Column:
    """Two hashes of every piece of every paragraph."""
    return _hashed(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)))


def paragraph_hashes(text: Column) -> Column:
    """Two hashes of every whole paragraph."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(SPACE)))
    return _hashed(F.filter(lines, lambda x: x != ""))


def _total(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + part(h))


def _lane_total(hashes: Column, part) -> Column:
    """As ``_total`` for three lanes at once. Where a lane may overflow, its highest bit is added without a carry."""
    apart = F.aggregate(
        hashes,
        F.lit(0).cast("long"),
        lambda s, h: (s.bitwiseAND(F.lit(~TOP)) + part(h)).bitwiseXOR(s.bitwiseAND(F.lit(TOP))),
    )
    return F.when(F.size(hashes) <= SAFE, _total(hashes, part)).otherwise(apart)


def vector(hashes: Column, paragraphs: Column) -> Column:
    """(n, lanes, wide): number of pieces, 42 longs of three lanes, four sums modulo 2**32 over whole paragraphs."""
    lanes = [
        _lane_total(hashes, lambda h, f=f, k=k: F.shiftrightunsigned(h[f], k).bitwiseAND(F.lit(TAKE)))
        for f in "ab"
        for k in range(LANE_BITS)
    ]
    wide = [
        _total(paragraphs, lambda h, f=f, k=k: F.shiftrightunsigned(h[f], k).bitwiseAND(F.lit(WIDE))).bitwiseAND(F.lit(WIDE))
        for f in "ab"
        for k in (0, 32)
    ]
    n = F.size(hashes).cast("long")
    return F.struct(n.alias("n"), F.array(*lanes).alias("lanes"), F.array(*wide).alias("wide"))


def combine(x: Column, y: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together; with ``sign`` -1, of x without the paragraphs of y.

    Lanes are added one by one modulo 2**21, so that nothing is carried from one to the next.
    """

    def lane(a: Column, b: Column) -> Column:
        out = F.lit(0).cast("long")
        for s in (0, LANE_BITS, 2 * LANE_BITS):
            one = lambda v, s=s: F.shiftrightunsigned(v, s).bitwiseAND(F.lit(LANE))
            out = out + F.shiftleft((one(a) + sign * one(b)).bitwiseAND(F.lit(LANE)), s)
        return out

    return F.struct(
        (x["n"] + sign * y["n"]).alias("n"),
        F.zip_with(x["lanes"], y["lanes"], lane).alias("lanes"),
        F.zip_with(x["wide"], y["wide"], lambda a, b: (a + sign * b).bitwiseAND(F.lit(WIDE))).alias("wide"),
    )


def digits(v: Column) -> Column:
    """A fingerprint as 704 hexadecimal digits."""
    lanes = F.transform(v["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    wide = F.transform(v["wide"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.array_join(F.concat(lanes, wide), "")


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)


def _signs(v: Column) -> Column:
    """The 126 sums of random signs as doubles."""

    def lanes(shift: int) -> Column:
        ones = lambda x: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LANE))
        return F.transform(v["lanes"], lambda x: (2 * ones(x) - v["n"]).cast("double"))

    return F.concat(*[lanes(s) for s in (0, LANE_BITS, 2 * LANE_BITS)])


def likeness(x: Column, y: Column) -> Column:
    """Estimated share of pieces in common, 2 |x & y| / (|x| + |y|), in 0 to 1; 1 for equal fingerprints.

    The standard error is about 0.13 where nothing is shared and falls to 0 towards equality. Two texts
    without words are alike, one without is unlike any other.
    """
    apart = _squares(F.zip_with(_signs(x), _signs(y), lambda a, b: a - b))
    size = _squares(_signs(x)) + _squares(_signs(y))
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / size))
    return (
        F.when(digits(x) == digits(y), 1.0).when((x["n"] == 0) | (y["n"] == 0) | (size == 0), 0.0).otherwise(estimate)
    )


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text as a struct; NULL is read as an empty text."""
    body = F.col(text).cast("string")
    hashed = docs.select("*", piece_hashes(body).alias("_hashes"), paragraph_hashes(body).alias("_paragraphs"))
    return hashed.select(*docs.columns, vector(F.col("_hashes"), F.col("_paragraphs")).alias(name))


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the key: first among every so many of them, then among those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    whole = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    k = F.size(F.filter(whole, lambda b: b < key))
    return k * step + F.size(F.filter(F.coalesce(F.get(inner, k), F.array().cast("array<bigint>")), lambda b: b < key))


def with_next(keyed: DataFrame, carry: list[str], adding: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``keyed`` (unique ``_doc``) with ``next_*`` of the row with the next smaller key; the smallest gets the largest's.

    Rows are cut into ranges of the key at approximate quantiles, so the texts are shuffled once and no task gets more
    than its range. The first row of every range goes along to the range before as well, behind that range's own rows.
    Columns that ``adding`` adds are worked out once for each of these rows. The driver sees the bounds and the largest key of each range, four times as many as there are shuffle partitions.
    """
    spark = keyed.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(keyed.agg(F.percentile_approx(KEY, at, 10_000)).first()[0] or []))
    cut = keyed.withColumn("_range", _place(F.col(KEY), bounds))
    heads = sorted((r[0], r[1]) for r in cut.groupBy("_range").agg(F.max(KEY)).collect())
    before = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    to = spark.createDataFrame(before, f"{KEY} long, _range int")
    also = keyed.join(F.broadcast(to), KEY).withColumn("_also", F.lit(True))
    both = adding(cut.withColumn("_also", F.lit(False)).unionByName(also))
    added = [c for c in both.columns if c not in (*keyed.columns, "_range", "_also")]
    lead = F.lead(F.struct(*carry)).over(W.partitionBy("_range").orderBy("_also", F.col(KEY).desc()))
    own = both.withColumn("_next", lead).filter(~F.col("_also"))
    return own.select(*keyed.columns, *added, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carry])


def edited(text: Column, following: Column) -> Column:
    """The text whose last floor(n/2) code points are replaced by as many of the following text's first, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The next document is the one before it in ascending order of the id; after the smallest id comes the largest. A
    single document is its own next one. NULL texts are empty.
    """
    keyed = identified(docs, doc_id).select(
        KEY, F.col(f"row.{doc_id}").alias("doc_id"), F.coalesce(F.col(f"row.{text}").cast("string"), F.lit("")).alias("body")
    )
    follow = with_next(keyed, ["body", "fp"], adding=lambda df: fingerprints(df, "body", "fp"))
    out = fingerprints(follow.withColumn("changed", edited(F.col("body"), F.col("next_body"))), "changed", "fe")
    return out.select(
        "doc_id",
        F.length("body").cast("long").alias("n_chars"),
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        digits(F.col("fp")).alias("fingerprint"),
        digits(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
