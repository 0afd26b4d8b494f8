import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.functions import beta, normal, student
from samplewright.functions.hashing import order_key, slice_of
from samplewright.functions.nulls import clamp_above, null_safe, ratio, strict


@pytest.mark.parametrize("df, t", [(2, 4.302653), (14, 2.144787), (29, 2.045230), (49, 2.009575)])
def test_t_quantile_published_values(df, t):
    assert student.quantile(0.95, np.array([df]))[0] == pytest.approx(t, abs=1e-6)


def test_t_quantile_columns_match_the_exact_quantile(spark):
    dfs = [1.0, 1.5, 2.0, 2.7, 5.0, 29.0, 48.37, 200.0, 201.0, 1000.0, 1e6]
    frame = spark.createDataFrame([(d,) for d in dfs], "d double")
    for level in (0.9, 0.95, 0.99):
        got = frame.select("d", student.t_quantile("d", level).alias("t")).collect()
        for d, t in got:
            assert t == pytest.approx(student.quantile(level, np.array([d]))[0], rel=1e-11)
        whole = frame.filter("d = floor(d)").selectExpr("cast(d as int) d")
        for d, t in whole.select("d", student.t_quantile_whole("d", level).alias("t")).collect():
            assert t == pytest.approx(student.quantile(level, np.array([float(d)]))[0], rel=1e-10)


def test_t_quantile_below_one_degree_is_unknown(spark):
    frame = spark.createDataFrame([(0.5,), (None,)], "d double")
    assert [r.t for r in frame.select(student.t_quantile("d").alias("t")).collect()] == [None, None]


def test_two_sided_p(spark):
    a, b = 2.5 / 5, (20 / 3) / 4
    t, df = -2 / (a + b) ** 0.5, (a + b) ** 2 / (a**2 / 4 + b**2 / 3)
    frame = spark.createDataFrame(
        [(t, df), (0.0, 3.0), (1.0, 1.0), (40.0, 10.0), (None, 2.0)], "t double, df double"
    )
    p = [r.p for r in frame.select(beta.two_sided_p("t", "df").alias("p")).collect()]
    assert p[0] == pytest.approx(0.2351941114, abs=1e-9)
    assert p[1] == pytest.approx(1.0)
    assert p[2] == pytest.approx(0.5)  # Cauchy
    assert 0 < p[3] < 1e-10
    assert p[4] is None


def test_two_sided_p_over_the_whole_range(spark):
    """Against the vectorised tail, in relative terms, so that small p values count too."""
    dfs = [0.4, 1.0, 1.7, 2.0, 4.749, 11.3, 30.0, 61.5, 333.0, 4321.0, 59_998.4, 999_999.0, 3e6, 1e9]
    ts = [0.0, 1e-9, 1e-3, 0.4, 1.0, 1.7, 1.96, 3.0, 7.5, 20.0, -5.0]
    frame = spark.createDataFrame([(t, d) for d in dfs for t in ts], "t double, df double")
    for r in frame.withColumn("p", beta.two_sided_p("t", "df")).collect():
        want = 2 * float(student.upper_tail(np.array([abs(r.t)]), np.array([r.df]))[0])
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300), r
    # Closed forms: one and two degrees of freedom.
    for r in frame.filter("df IN (1.0, 2.0)").withColumn("p", beta.two_sided_p("t", "df")).collect():
        t = abs(r.t)
        want = 2 * math.atan2(1, t) / math.pi if r.df == 1 else 2 / ((math.sqrt(2 + t * t) + t) * math.sqrt(2 + t * t))
        assert r.p == pytest.approx(want, rel=1e-12)


def test_p_values_need_no_python(spark):
    frame = spark.createDataFrame([(1.0, 2.5), (None, 2.0), (1.0, None), (1.0, 0.0)], "t double, df double")
    found = frame.select(beta.two_sided_p("t", "df").alias("p"))
    assert "Python" not in found._jdf.queryExecution().toString() and [r.p is None for r in found.collect()] == [False, True, True, True]


def test_p_and_quantile_are_inverse():
    df = np.array([1.3, 4.749, 30.0, 333.0, 1e5, 1e9])
    assert 2 * student.upper_tail(student.quantile(0.95, df), df) == pytest.approx(0.05, rel=1e-10)


def test_normal_tail_is_accurate_in_relative_terms(spark):
    xs = [-8.0, -1.0, 0.0, 0.3, 1.96, 5.0, 12.0, 30.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(normal.upper_tail("x").alias("p")).collect()
    for x, (p,) in zip(xs, got):
        assert p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-11)


def test_wilson_published_example(spark):
    frame = spark.createDataFrame([(81, 263), (0, 10), (10, 10), (None, 10), (0, 0)], "x int, n int")
    ci = [r.c for r in frame.select(normal.wilson("x", "n").alias("c")).collect()]
    assert (ci[0].lower, ci[0].upper) == pytest.approx((0.2553, 0.3662), abs=1e-4)
    assert ci[1].lower == pytest.approx(0.0, abs=1e-12) and ci[2].upper == pytest.approx(1.0)
    assert tuple(ci[3]) == tuple(ci[4]) == (None, None, None)
    for c in ci[:3]:
        assert c.lower <= c.point + 1e-12 and c.point <= c.upper + 1e-12


def test_strict_aggregates(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 5.0), (3, None)], "g int, x double")
    got = {r.g: (r.a, r.s) for r in frame.groupBy("g").agg(
        strict(F.avg, "x").alias("a"), strict(F.sum, "x").alias("s")).collect()}
    assert got == {1: (None, None), 2: (4.0, 8.0), 3: (None, None)}


def test_ratio_and_clamp(spark):
    frame = spark.createDataFrame([(None,), (1.0,), (2.0,), (2.5,), (0.0,)], "x double")
    got = frame.select(clamp_above("x", 2.0).alias("c"), ratio(F.lit(1), "x").alias("r")).collect()
    assert [r.c for r in got] == [None, 1.0, 2.0, 2.0, 0.0]
    assert [r.r for r in got] == [None, 1.0, 0.5, 0.4, None]


def test_null_safe_key_joins_unknown_with_unknown(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "g int, a int").selectExpr("a", f"{null_safe('g')} k")
    right = spark.createDataFrame([(None, 10), (1, 20)], "g int, b int").selectExpr("b", f"{null_safe('g')} k")
    assert sorted((r.a, r.b) for r in left.join(right, "k").collect()) == [(1, 10), (2, 20)]


@pytest.mark.parametrize("rng", ["xxhash64", "md5"])
@pytest.mark.parametrize("slices", [1, 7, 200])
def test_slices_follow_the_hash_order_and_are_even(spark, rng, slices):
    keyed = spark.range(20000).selectExpr(f"{order_key(rng, 1, 'id')} AS h").selectExpr(
        "h", f"{slice_of(rng, 'h', slices)} AS s"
    )
    found = [r.s for r in keyed.orderBy("h").collect()]
    assert found == sorted(found)
    assert set(found) == set(range(slices))
    assert max(np.bincount(found)) < 2 * 20000 / slices


def test_unknown_rng_is_refused():
    with pytest.raises(ValueError):
        order_key("mt19937", 1, "id")
