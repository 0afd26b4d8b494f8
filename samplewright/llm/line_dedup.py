"""Removal of repeated runs of lines, by a suffix array over line ids built by distributed prefix doubling.

All lines of the corpus, in document order, get consecutive positions, with a gap after each document. The rank of
a suffix after k rounds of doubling names the block of ``2 ** k`` lines it begins with; the rank of two neighbouring
blocks of equal length together is found by grouping on their two ranks. As only equality and first places are
asked for, a rank is the first position of its block, which is exact and survives recomputation. Blocks that occur
once are dropped in every round, so a round costs what is still repeated.

The suffixes that share their first L lines are an interval of the suffix array with longest common prefix L. From
the largest block down, every suffix tries to lengthen the prefix it shares with an earlier suffix by one block: the
interval it is in, and the rank of the next block, name the narrower interval. The first suffix of an interval is
left there as its head, so that later and shorter tries still find it. What remains is, for every line, the longest
run starting there that has begun before.

DataFrame operations only: no group is collected, and no pairs within a group are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import settle


def _line_table(keyed: DataFrame, text: str) -> DataFrame:
    """(pos, _doc, line, h1, h2, words): one row per line of every text, positions in document order."""
    lines = F.split(F.coalesce(F.col(f"row.{text}").cast("string"), F.lit("")), "\n", -1)
    hashed = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(x).alias("h1"),
            F.xxhash64(F.lit(1), x).alias("h2"),
            F.regexp_count(x, F.lit(r"\S+")).alias("words"),
        ),
    )
    # Stored as arrays first: the range shuffle samples its input, which would hash all texts twice.
    arrays = settle(keyed.select(KEY, hashed.alias("lines")))
    gap = F.array(F.struct(F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(0).alias("words")))
    rows = (
        arrays.repartitionByRange(KEY)
        .sortWithinPartitions(KEY)
        .select(KEY, F.posexplode(F.concat("lines", gap)).alias("line", "x"))
        .select(F.monotonically_increasing_id().alias("pos"), KEY, "line", "x.h1", "x.h2", "x.words")
    )
    return settle(rows.filter("h1 IS NOT NULL"))


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose key occurs at least twice, with the first position of the key as ``rank``.

    The groups are stored, so that the join has plain shuffles on both sides and a hot key is split when it runs.
    """
    groups = rows.groupBy(*key).agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(settle(groups), list(key))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """By round k: (pos, rank, words) of the blocks of 2**k lines that occur more than once."""
    level = settle(_named(lines, "h1", "h2").select("pos", "rank", "words"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        step = 1 << (len(levels) - 1)
        after = level.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"), F.col("words").alias("more"))
        two = settle(level.join(after, "pos").select("pos", "rank", "next", (F.col("words") + F.col("more")).alias("words")))
        named = _named(two.withColumnRenamed("rank", "own"), "own", "next")
        level = settle(named.select("pos", "rank", "words"))
    return levels


def earlier_runs(levels: list[DataFrame]) -> DataFrame:
    """(pos, length, words): the longest run of lines from ``pos`` that also starts at an earlier position."""
    state = None
    for k in reversed(range(len(levels))):
        size, blocks = 1 << k, levels[k]
        entered = blocks.filter("rank < pos")
        if k + 1 < len(levels):  # those repeated at twice the length are in the state already
            entered = entered.join(levels[k + 1].filter("rank < pos").select("pos"), "pos", "left_anti")
        entered = entered.select("pos", F.lit(size).alias("length"), "rank", "words", F.lit(False).alias("head"))
        if state is not None:
            ahead = blocks.select(F.col("pos").alias("to"), F.col("rank").alias("next"), F.col("words").alias("more"))
            tried = state.withColumn("to", F.col("pos") + F.col("length")).join(ahead, "to", "left").drop("to")
            tried = settle(tried)
            inner = settle(
                tried.filter("next IS NOT NULL")
                .groupBy("length", "rank", "next")
                .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1")
                .drop("n")
            )
            longer = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
            both = tried.join(inner, ["length", "rank", "next"], "left")
            state = both.select(
                "pos",
                (F.col("length") + F.when(longer, size).otherwise(0)).alias("length"),
                F.when(longer, F.col("first")).otherwise(F.col("rank")).alias("rank"),
                (F.col("words") + F.when(longer, F.col("more")).otherwise(0)).alias("words"),
                "head",
            )
            heads = both.filter("pos = first").select(
                "pos", (F.col("length") + size).alias("length"), F.col("pos").alias("rank"),
                (F.col("words") + F.col("more")).alias("words"), F.lit(True).alias("head"),
            )
            state = state.union(heads)
        fresh = entered.groupBy("rank").agg(F.first("words").alias("words"))
        fresh = fresh.select(F.col("rank").alias("pos"), F.lit(size).alias("length"), "rank", "words", F.lit(True).alias("head"))
        state = settle(entered.union(fresh) if state is None else state.union(entered).union(fresh))
    return state.filter(~F.col("head")).select("pos", "length", "words")


def _without(text: Column, cuts: Column) -> Column:
    """The text without the runs of lines in ``cuts``, sorted (first, last) pairs."""
    lines = F.split(text, "\n", -1)
    n = F.size(cuts)
    start = lambda i: F.when(i == 0, 0).otherwise(F.element_at(cuts, i)["last"] + 1)
    stop = lambda i: F.when(i == n, F.size(lines)).otherwise(F.element_at(cuts, i + 1)["first"])
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i)))
    return F.array_join(F.flatten(kept), "\n")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(_doc, row, cuts, n_lines_removed): each row with the runs of its lines that occur earlier.

    A line is what stands between line breaks, compared by 128 bits of hash. A run is removed if it has at least
    ``min_words`` words and starts at an earlier position too, the order being that of (id, line); the first copy
    always stays. Runs never cross documents. ``cuts`` holds (first, last) line numbers from 0, NULL if nothing
    goes. NULL texts are left as they are; repeated ids are told apart by row.
    """
    keyed = identified(docs, doc_id)
    lines = _line_table(keyed, text)
    levels = suffix_ranks(lines)
    if not levels:
        none = F.lit(None).cast("array<struct<first:int,last:int>>")
        return keyed.select(KEY, "row", none.alias("cuts"), F.lit(0).cast("long").alias("n_lines_removed"))
    runs = earlier_runs(levels).filter(F.col("words") >= min_words).select("pos", "length")
    active = lines.join(levels[0].select("pos"), "pos", "left_semi").select("pos", KEY, "line").join(runs, "pos", "left")
    so_far = W.partitionBy(KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    gone = active.withColumn("reach", F.max(F.col("pos") + F.col("length")).over(so_far)).filter("pos < reach")
    island = F.col("line") - F.row_number().over(W.partitionBy(KEY).orderBy("line"))
    spans = (
        gone.select(KEY, "line", island.alias("island"))
        .groupBy(KEY, "island")
        .agg(F.struct(F.min("line").alias("first"), F.max("line").alias("last")).alias("cut"))
    )
    cuts = spans.groupBy(KEY).agg(
        F.sort_array(F.collect_list("cut")).alias("cuts"),
        F.sum(F.col("cut.last") - F.col("cut.first") + 1).alias("n_lines_removed"),
    )
    # A shuffle at every size: what a cut costs must not change with the number of cuts.
    return keyed.join(settle(cuts).hint("merge"), KEY, "left").select(
        KEY, "row", "cuts", F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed")
    )


def cleaned(found: DataFrame, text: str = "text") -> Column:
    """The text of a row of ``repeated_lines`` without what is to go."""
    body = F.col(f"row.{text}").cast("string")
    return F.when(F.col("cuts").isNull(), body).otherwise(_without(body, F.col("cuts")))
