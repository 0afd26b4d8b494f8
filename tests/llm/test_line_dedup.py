import random

import pytest
from pyspark.sql import functions as F

from samplewright.llm import line_dedup


def slow(texts, min_words):
    """Lines that lie in a run of enough words that starts at an earlier place too; texts in order."""
    lines = [(t or "").split("\n") for t in texts]
    out = []
    for d, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            best = 0
            for e in range(d + 1):
                for j in range(len(lines[e]) if e < d else i):
                    n = 0
                    while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(x.split()) for x in own[i : i + best]) >= min_words:
                gone |= set(range(i, i + best))
        out.append((None if texts[d] is None else "\n".join(x for k, x in enumerate(own) if k not in gone), len(gone)))
    return out


def run(spark, texts, min_words):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = line_dedup.repeated_lines(df, min_words=min_words)
    got = found.select(F.col("row.doc_id").alias("d"), line_dedup.cleaned(found).alias("t"), "n_lines_removed").collect()
    return [(r.t, r.n_lines_removed) for r in sorted(got, key=lambda r: r.d)]


@pytest.mark.parametrize("seed,words", [(1, 1), (2, 3), (3, 5)])
def test_against_brute_force(spark, seed, words):
    rng = random.Random(seed)
    vocabulary = ["a", "b c", "d", "", "e f g"]
    texts = ["\n".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(14)]
    texts += [texts[0], texts[1] + "\n" + texts[2], None, ""]
    assert run(spark, texts, words) == slow(texts, words)


def test_maximal_run_is_removed_with_its_short_tail(spark):
    block = [f"{i} " * 30 for i in range(3)] + ["tail"]
    texts = ["\n".join(["head", *block, "one"]), "\n".join(["other", *block, "two"]), "tail"]
    assert run(spark, texts, 50) == [(texts[0], 0), ("other\ntwo", 4), ("tail", 0)]


def test_one_line_many_times(spark):
    assert run(spark, ["x y\n" * 300], 2) == [("x y\n", 299)]


def test_nothing_repeats(spark):
    assert run(spark, ["a\nb", "c"], 1) == [("a\nb", 0), ("c", 0)]


def test_messy_rows_and_empty_tables(messy, empty):
    docs = messy(["same words here\nand there", "same words here\nand there", "b"])
    found = line_dedup.repeated_lines(docs, min_words=3)
    got = found.select("row.doc_id", line_dedup.cleaned(found).alias("t"), "n_lines_removed", "row.fp").collect()
    assert len(got) == docs.count()
    texts = sorted((r.doc_id, r.t or "") for r in got if r.doc_id in (0, 1, 104))
    assert texts == [(0, "same words here\nand there"), (1, ""), (104, ""), (104, "the same row twice")]
    assert [r.t for r in got if r.doc_id == 100] == [None]
    assert line_dedup.repeated_lines(empty).count() == 0
