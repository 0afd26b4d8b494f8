import itertools
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.operators import ordering


def grouped(spark, sizes):
    data = [(g, u, float((u * 7919 + i) % 101)) for i, (g, n) in enumerate(sizes.items()) for u in range(n)]
    return spark.createDataFrame(data, "g string, u int, v double")


SIZES = {"hot": 900, "small": 3, None: 40, "one": 1}


@pytest.mark.parametrize("rng", ["xxhash64", "md5"])
def test_shuffle_rank_permutes_every_group(spark, rng):
    df = grouped(spark, SIZES)
    got = ordering.shuffle_rank(df, "g", "u", rng=rng, total="size").collect()
    for g, n in SIZES.items():
        mine = [r for r in got if r.g == g]
        assert sorted(r.ordinal for r in mine) == list(range(1, n + 1))
        assert {r["size"] for r in mine} == {n}
        assert sorted(r.u for r in mine) == list(range(n))
    hot = [r.u for r in sorted((r for r in got if r.g == "hot"), key=lambda r: r.ordinal)]
    assert hot != sorted(hot)


def test_shuffle_rank_does_not_depend_on_partitioning(spark):
    df = grouped(spark, SIZES)
    first = sorted(map(str, ordering.shuffle_rank(df, "g", "u").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = sorted(map(str, ordering.shuffle_rank(df.repartition(7), "g", "u").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
    other = sorted(map(str, ordering.shuffle_rank(df, "g", "u", seed=1).collect()))
    assert first != other


def test_shuffle_rank_moves_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ordering.shuffle_rank(grouped(spark, SIZES), "g", "u")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows once, and three times the totals per bucket
    assert plan.count("Exchange hashpartitioning") == 4
    assert "SinglePartition" not in plan


def test_row_index_equals_the_single_partition_window(spark):
    df = grouped(spark, {"a": 50, "b": 70, None: 5})
    got = {(r.g, r.u): r.i for r in ordering.row_index(df, ["v", "g", "u"], "i").collect()}
    w = W.orderBy(*[F.col(c).asc_nulls_last() for c in ("v", "g", "u")])
    expected = {(r.g, r.u): r.i - 1 for r in df.withColumn("i", F.row_number().over(w)).collect()}
    assert got == expected


def test_group_row_number_equals_the_window(spark):
    df = grouped(spark, SIZES)
    got = sorted(map(str, ordering.group_row_number(df, "g", ["v", "u"], "i").collect()))
    w = W.partitionBy("g").orderBy("v", "u")
    assert got == sorted(map(str, df.withColumn("i", F.row_number().over(w).cast("long")).collect()))


def test_weighted_start(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 2), ("a", 3, 1)], "g string, o int, w int")
    got = sorted(tuple(r) for r in ordering.weighted_start(df, "g", "o", "w").collect())
    assert got == [("a", 1, 5, 0, 13), ("a", 2, 7, 5, 13), ("a", 3, 1, 12, 13), ("b", 1, 2, 0, 2)]


def test_global_lag_crosses_iterations_sizes_and_groups(spark):
    cells = list(itertools.product("abc", (3, 4), (1, 2)))
    df = spark.createDataFrame([(*k, float(i)) for i, k in enumerate(cells, 1)], "g string, n int, i int, w double")
    got = sorted(tuple(r) for r in ordering.global_lag(df.repartition(5), "w", ["g", "n", "i"]).collect())
    assert [r[4] for r in got] == [None, *[float(i) for i in range(1, 12)]]
    by_g = sorted(tuple(r) for r in ordering.global_lag(df, "w", ["g", "n", "i"], part="g").collect())
    assert got == by_g


def test_global_lag_with_unknown_groups_and_values(spark):
    df = spark.createDataFrame(
        [(None, 1, 9.0), ("a", 1, 1.0), ("a", 2, None), ("b", 1, 3.0)], "g string, i int, w double"
    )
    got = {(r.g, r.i): r.lagged for r in ordering.global_lag(df, "w", ["g", "i"]).collect()}
    # unknown groups sort last
    assert got == {("a", 1): None, ("a", 2): 1.0, ("b", 1): None, (None, 1): 3.0}


def test_global_lag_after_an_unknown_position(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, 2.0), ("b", 1, 3.0)], "g string, i int, w double")
    got = {(r.g, r.i): r.lagged for r in ordering.global_lag(df, "w", ["g", "i"]).collect()}
    assert got == {("a", 1): None, ("a", None): 1.0, ("b", 1): 2.0}


def test_global_lag_wants_a_prefix(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "g int, i int, w double")
    for part in (["i"], ["g", "i"]):
        with pytest.raises(ValueError):
            ordering.global_lag(df, "w", ["g", "i"], part=part)


def test_exact_median(spark):
    df = grouped(spark, SIZES).withColumn("v", F.when(F.col("u") % 10 != 3, F.col("v")))
    local = df.collect()
    got = {r.g: r["median"] for r in ordering.exact_median(df, "v", "g").collect()}
    for g in SIZES:
        assert got[g] == statistics.median(r.v for r in local if r.g == g and r.v is not None)
    whole = ordering.exact_median(df, "v").collect()
    assert whole[0]["median"] == statistics.median(r.v for r in local if r.v is not None)


def test_ties_are_spread_over_partitions(spark):
    df = spark.range(4000).selectExpr("'hot' AS g", "1 AS o", "id AS u")
    numbered = ordering.group_row_number(df, "g", "o", "i")
    assert sorted(r.i for r in numbered.collect()) == list(range(1, 4001))
    parts = ordering.row_index(df, "o", "i").groupBy(F.floor(F.col("i") / 1000)).count()
    assert {r["count"] for r in parts.collect()} == {1000}
    ranged = df.repartitionByRange(4, "o", F.expr(ordering._tie_break(df, ["g", "o"])[0]))
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_identical_rows_are_numbered_once_each(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 3, "g string, o int")
    got = sorted((r.g, r.i) for r in ordering.group_row_number(df, "g", "o", "i").collect())
    assert got == [("a", i) for i in range(1, 51)] + [("b", i) for i in range(1, 4)]
    assert sorted(r.i for r in ordering.row_index(df, "o", "i").collect()) == list(range(53))


def test_lag_with_a_hot_key_spreads_over_tasks(spark):
    rows = [("hot" if u % 10 else f"k{u}", u, float(u)) for u in range(400)]
    df = spark.createDataFrame(rows, "g string, u int, v double").repartition(5)
    got = sorted((r.g, r.u, r.lagged) for r in ordering.global_lag(df, "v", ["g", "u"]).collect())
    want = sorted((g, u, v) for g, u, v in rows)
    assert [x[2] for x in got] == [None, *[x[2] for x in want][:-1]]


def test_rows_that_share_a_unit_keep_their_places(spark):
    rows = [("g", u % 3, i) for i, u in enumerate(range(300))]
    df = spark.createDataFrame(rows, "g string, u int, x int")
    ranks = [
        {r.x: r.ordinal for r in ordering.shuffle_rank(d, "g", "u").collect()} for d in (df, df.repartition(7), df.orderBy("x"))
    ]
    assert ranks[0] == ranks[1] == ranks[2] and sorted(ranks[0].values()) == list(range(1, 301))
