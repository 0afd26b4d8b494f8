import pytest
from pyspark.sql import functions as F

from samplewright.operators import comparison, coverage, precision
from samplewright.plans import studies

CI = "g string, sample_size int, iter int, median_pop_val double, lower_ci double, upper_ci double"


def test_hit_flag_is_unknown_on_a_bound(spark):
    cases = [(5.0, 1.0, 6.0), (0.0, 1.0, 6.0), (7.0, 1.0, 6.0), (1.0, 1.0, 6.0), (6.0, 1.0, 6.0), (None, 1.0, 6.0)]
    df = spark.createDataFrame([("a", 3, i, *c) for i, c in enumerate(cases, 1)], CI)
    flags = [r.ci_falls for r in coverage.hit_flag(df).collect()]
    assert flags == [1.0, 0.0, 0.0, None, None, None]
    flags = [r.ci_falls for r in coverage.hit_flag(df, boundary="covered").collect()]
    assert flags == [1.0, 0.0, 0.0, 1.0, 1.0, None]
    with pytest.raises(ValueError):
        coverage.hit_flag(df, boundary="open")


def test_coverage_counts_against_the_largest_iteration(spark):
    df = spark.createDataFrame(
        [("a", 3, 1, 2.0, 1.0, 3.0), ("a", 3, 4, 9.0, 1.0, 3.0), ("b", 3, 1, 2.0, 1.0, 3.0), ("b", 3, 2, 1.0, 1.0, 3.0)], CI
    )
    got = {r.g: (r.n_correct, r.max_n, r.prop_correct) for r in coverage.coverage(df, "g").collect()}
    assert got == {"a": (1.0, 4, 0.25), "b": (None, 2, None)}
    curve = studies.coverage_curve(df, "g").collect()
    assert curve[0].prop_correct is None  # one unknown group voids the pooled value


def test_precision_tables(spark):
    data, w = [], 0.0
    for g in ("a", "b"):
        for n in (4, 9):
            for i in (1, 2, 3):
                w = w + i * (1.0 if g == "a" else 2.0)
                data.append((g, n, i, 0.0, 0.0, w))
    df = spark.createDataFrame(data, CI)
    widths = [r[5] for r in data]
    change = [None, *[abs(b - a) for a, b in zip(widths, widths[1:])]]
    mean = lambda x: sum(x) / len(x)
    got = {(r.g, r.sample_size): r for r in precision.precision_by_group(df, "g").collect()}
    assert got["a", 4].dw_ci is None and got["a", 4].w_ci == pytest.approx(mean(widths[:3]))
    assert got["b", 9].dw_ci == pytest.approx(mean(change[9:]))
    pooled = {r.sample_size: r for r in precision.pooled_change(df, "g", with_sd=True).collect()}
    c4 = (mean(change[1:3]) + mean(change[6:9])) / 2  # unknown skipped here
    assert pooled[4].ci_change_mean == pytest.approx(c4)
    assert (pooled[4].lower_se, pooled[4].upper_se) == pytest.approx((c4 / 2, c4 * 1.5))
    assert pooled[9].ci_se == pytest.approx(pooled[9].ci_change_sd / 9)
    rel = {r.sample_size: r for r in precision.pooled_width_rel(df, "g").collect()}
    w9 = (mean(widths[3:6]) + mean(widths[9:])) / 2
    assert rel[9].ci_mean == pytest.approx(w9)
    assert rel[9].upper_se == pytest.approx(w9 * (1 + 1 / 3))
    se = {r.sample_size: r for r in precision.pooled_width_se(df, "g").collect()}
    assert se[9].mean_p == pytest.approx(w9)
    assert se[9].upper - se[9].mean_p == pytest.approx(se[9].mean_se)
    measured = precision.measure(df, "g")
    assert sorted(map(tuple, precision.pooled_change(measured, "g").collect())) == sorted(
        map(tuple, precision.pooled_change(df, "g").collect())
    )


def test_focus_keeps_unknown_and_drops_small_sizes(spark):
    df = spark.createDataFrame([(3, 1.0), (4, None), (5, 2.0), (6, 2.5)], "sample_size int, m double")
    assert [tuple(r) for r in precision.focus(df, "m").collect()] == [(4, None), (5, 2.0), (6, 2.0)]
    assert precision.focus(df).count() == 3


def two(spark):
    data = [("x", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5], 1)]
    data += [("y", i, float(v)) for i, v in enumerate([2, 4, 6, 8], 1)]
    return spark.createDataFrame(data, "g string, u int, v double")


def test_welch_by_hand(spark):
    r = comparison.welch_test(two(spark), "g", "v").collect()[0]
    assert (r.group1, r.group2, r.mean1, r.mean2) == ("x", "y", 3.0, 5.0)
    a, b = 2.5 / 5, (20 / 3) / 4
    assert r.t == pytest.approx(-2 / (a + b) ** 0.5)
    assert r.df == pytest.approx((a + b) ** 2 / (a**2 / 4 + b**2 / 3))
    assert r.p_value == pytest.approx(0.2352, abs=1e-4)
    assert r.lower_ci < -2 < r.upper_ci
    swapped = comparison.welch_test(two(spark), "g", "v", [("y", "x")]).collect()[0]
    assert swapped.t == pytest.approx(-r.t) and swapped.p_value == pytest.approx(r.p_value)
    assert (swapped.lower_ci, swapped.upper_ci) == pytest.approx((-r.upper_ci, -r.lower_ci))


def test_welch_needs_two_groups_and_two_values(spark):
    df = two(spark)
    for wrong in (df.filter("g = 'x'"), df.union(df.limit(1).select(F.lit("z"), F.lit(9), F.lit(1.0)))):
        for test in (comparison.welch_test, comparison.pooled_se):
            with pytest.raises(Exception, match="exactly two groups"):
                test(wrong, "g", "v").collect()
    with pytest.raises(Exception, match="no rows in"):
        comparison.welch_test(df, "g", "v", [("x", "nobody")]).collect()
    single = df.filter("g = 'x' or u = 1")
    r = comparison.welch_test(single, "g", "v").collect()[0]
    assert r.t is None and r.p_value is None and r.lower_ci is None


def test_pooled_se_and_design(spark):
    pooled = comparison.pooled_se(two(spark), "g", "v")
    r = pooled.collect()[0]
    s = ((4 * 2.5 + 3 * 20 / 3) / 7) ** 0.5
    assert r.s_pooled == pytest.approx(s) and r.se_diff == pytest.approx(s * (1 / 5 + 1 / 4) ** 0.5)
    got = comparison.design_analysis(pooled, [0.001, 1.0, 10.0]).collect()
    assert [g.possible_effect for g in got] == [0.001, 1.0, 10.0]
    for g in got:
        assert 0.05 <= g.power <= 1 and 0 <= g.type_s <= 0.5 and g.type_m >= 1
    assert got[0].power == pytest.approx(0.05, abs=1e-4) and got[0].type_s == pytest.approx(0.5, abs=1e-2)
    assert got[2].type_m == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("effect, se, type_m", [(0.03, 0.539, 42.0), (0.15, 0.444, 7.0)])
def test_design_known_factors(spark, effect, se, type_m):
    df = spark.createDataFrame([(se,)], "se_diff double")
    assert comparison.design_analysis(df, [effect]).collect()[0].type_m == pytest.approx(type_m, rel=0.01)


def test_study_subset_and_summary(spark):
    df = two(spark)
    kept = comparison.study_subset(df, "g", ["x", "y"], 2, "u")
    assert sorted((r.g, r.n) for r in comparison.group_count(kept, "g").collect()) == [("x", 2), ("y", 2)]
    got = {r.g: r for r in comparison.group_summary(df.filter("g = 'x' or u = 1"), "g", "v").collect()}
    assert (got["x"].mean, got["x"].n) == (3.0, 5) and got["x"].se == pytest.approx((2.5 / 5) ** 0.5)
    assert got["y"].sd is None and got["y"].se is None


def test_two_group_tables(spark):
    tables = studies.two_group_tables(two(spark), "g", "x", "y", "v", "u", 4, [1.0], n_max=6, iters=11)
    curve = {r.sample_size: r for r in tables["curve"].collect()}
    assert [n for n, r in sorted(curve.items()) if r.extrapolated] == [5, 6]
    diff = tables["diff"].collect()[0]
    assert diff.mean_diff == pytest.approx(curve[4].mean_diff)
    assert tables["boot"].count() == 4 * 11
    assert tables["design"].count() == 1 and tables["welch"].count() == 1
    assert [tuple(r) for r in tables["counts"].orderBy("g").collect()] == [("x", 4), ("y", 4)]
    assert tables["summary"].count() == 2


def test_a_null_group_is_compared_with_the_other(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0), (None, 5.0), (None, 9.0)], "g string, v double")
    named = df.fillna("y", ["g"])
    for pairs in (None, [("x", None)]):
        got = comparison.welch_test(df, "g", "v", pairs).collect()[0]
        want = comparison.welch_test(named, "g", "v").collect()[0]
        assert (got.group1, got.group2) == ("x", None) and tuple(got)[2:] == tuple(want)[2:]


def test_the_sign_of_an_effect_does_not_matter(spark):
    df = spark.createDataFrame([(1.0,)], "se_diff double")
    up, down = comparison.design_analysis(df, [1.2, -1.2]).collect()
    assert tuple(up)[2:] == tuple(down)[2:] and down.possible_effect == -1.2
    with pytest.raises(ValueError):
        comparison.design_analysis(df, [0.0])
