import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from samplewright.operators import bootstrap, coverage
from samplewright.plans import studies

DATA = [("a", u, float(u * u % 17)) for u in range(23)] + [("b", u, 4.0) for u in range(4)] + [("c", 0, 1.5)]
GRID = dict(n_min=2, n_max=9, iters=7)


@pytest.fixture
def data(spark):
    return spark.createDataFrame(DATA, "g string, u int, v double")


def keyed(df):
    return {(r.g, r.sample_size, r.iter): (r.mean, r.sd) for r in df.collect()}


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def replay(seed=2012):
    """The md5 draws again, one at a time."""
    out = {}
    for g in "abc":
        pool = [v for _, v in sorted(((digest(seed, g, u), u), v) for h, u, v in DATA if h == g)]
        for n in range(GRID["n_min"], GRID["n_max"] + 1):
            for i in range(1, GRID["iters"] + 1):
                drawn = [pool[int(digest(seed, g, n, i, j)[:15], 16) % len(pool)] for j in range(1, n + 1)]
                out[g, n, i] = (statistics.fmean(drawn), statistics.stdev(drawn))
    return out


def assert_close(got, expected):
    assert got.keys() == expected.keys()
    for k, (mean, sd) in expected.items():
        assert got[k][0] == pytest.approx(mean, rel=1e-12), k
        assert got[k][1] == pytest.approx(sd, rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("chunk_rows", [1 << 15, 10, 1])
def test_md5_draws_equal_a_replay(data, chunk_rows):
    got = keyed(bootstrap.bootstrap_groups(data, "g", "v", "u", rng="md5", chunk_rows=chunk_rows, **GRID))
    assert_close(got, replay())


@pytest.mark.parametrize("rng", ["xxhash64", "md5"])
def test_draws_do_not_depend_on_partitions_chunks_lanes_or_batches(spark, data, rng, monkeypatch):
    expected = keyed(bootstrap.bootstrap_groups(data, "g", "v", "u", rng=rng, **GRID))
    batched = bootstrap.bootstrap_batches(data, [["a"], ["b", "c"]], "g", "v", "u", rng=rng, **GRID)
    assert keyed(batched) == expected
    monkeypatch.setattr(bootstrap, "LANE_DRAWS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        again = bootstrap.bootstrap_groups(data.repartition(6), "g", "v", "u", rng=rng, **GRID)
        assert keyed(again) == expected
        split = bootstrap.bootstrap_groups(data, "g", "v", "u", rng=rng, chunk_rows=4, **GRID)
        assert keyed(split) == expected  # to the last bit
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_resamples_stay_inside_their_group(data):
    got = keyed(bootstrap.bootstrap_groups(data, "g", "v", "u", **GRID))
    assert len(got) == 3 * 8 * 7
    for (g, n, i), (mean, sd) in got.items():
        values = [v for h, _, v in DATA if h == g]
        assert min(values) <= mean <= max(values)
        if g in "bc":
            assert sd == 0.0  # exactly: constant groups have no spread


def test_single_draws_have_no_sd(data):
    got = keyed(bootstrap.bootstrap_groups(data, "g", "v", "u", n_min=1, n_max=1, iters=3))
    assert all(sd is None and mean is not None for mean, sd in got.values())


@pytest.mark.parametrize("chunk_rows", [1 << 15, 5])
def test_an_unknown_value_voids_the_resamples_that_draw_it(spark, chunk_rows):
    df = spark.createDataFrame([("a", u, None if u == 0 else 1.0) for u in range(12)], "g string, u int, v double")
    got = keyed(bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=2, n_max=12, iters=20, chunk_rows=chunk_rows))
    void = [m for m, _ in got.values() if m is None]
    assert 0 < len(void) < len(got)
    assert {m for m, _ in got.values() if m is not None} == {1.0}


def test_unknown_group_is_a_group(spark):
    df = spark.createDataFrame([(None, u, float(u)) for u in range(5)], "g string, u int, v double")
    boot = bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=30, n_max=30, iters=5)
    got = bootstrap.attach_population_median(boot, "g").collect()
    assert len(got) == 5 and all(r.median_pop_val is not None for r in got)


def test_bad_grid_is_refused(data):
    for draw in (bootstrap.bootstrap_groups, bootstrap.bootstrap_with_median):
        with pytest.raises(ValueError):
            draw(data, "g", "v", "u", n_min=5, n_max=4)


def test_a_hot_group_is_packed_in_bounded_arrays(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 40 as string)) g", "id u", "double(id) v")
    packed = bootstrap.pack_groups(df, "g", "v", "u", chunk_rows=64).collect()
    assert max(len(r.vals) for r in packed) == 64
    assert sum(r.g == "hot" for r in packed) == 16
    assert sorted(v for r in packed for v in r.vals) == [float(i) for i in range(3000)]
    assert {(r.g, r.total) for r in packed if r.g == "hot"} == {("hot", 1000)}


def test_draws_are_uniform_over_the_group(spark):
    df = spark.range(500).selectExpr("'a' g", "id u", "double(id) v")
    for chunk_rows in (1 << 15, 64):
        boot = bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=1, n_max=1, iters=5000, chunk_rows=chunk_rows)
        drawn = [r.mean for r in boot.collect()]
        counts = [sum(int(v) // 50 == k for v in drawn) for k in range(10)]
        assert len(drawn) == 5000
        assert sum((c - 500) ** 2 / 500 for c in counts) < 33.7  # chi-square, 9 df, 1e-4


def test_whole_numbers_and_decimals_are_measurements_too(spark):
    df = spark.range(60).selectExpr("id % 2 g", "id u", "cast(id as int) i", "cast(id as decimal(9, 2)) d", "double(id) x")
    for chunk_rows in (1 << 15, 8):
        options = dict(n_min=2, n_max=3, iters=4, chunk_rows=chunk_rows)
        expected = keyed(bootstrap.bootstrap_groups(df, "g", "x", "u", **options))
        for v in ("i", "d"):
            boot = bootstrap.bootstrap_groups(df, "g", v, "u", **options)
            assert [t for _, t in boot.dtypes][-2:] == ["double", "double"]
            assert keyed(boot) == expected


def test_moments_survive_large_offsets(spark):
    df = spark.createDataFrame([("a", u, 1e9 + u % 2) for u in range(50)], "g string, u int, v double")
    for chunk_rows in (1 << 15, 7):
        boot = bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=40, n_max=40, iters=50, chunk_rows=chunk_rows)
        assert all(r.sd == pytest.approx(0.5, abs=0.07) for r in boot.collect())


def test_population_median_left_equals_full(data):
    boot = bootstrap.bootstrap_groups(data, "g", "v", "u", n_min=29, n_max=31, iters=9)
    left = bootstrap.attach_population_median(boot, "g")
    full = bootstrap.attach_population_median(boot, "g", how="full")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, full.collect()))
    at30 = [r.mean for r in boot.filter("g = 'a' and sample_size = 30").collect()]
    assert {r.median_pop_val for r in left.filter("g = 'a'").collect()} == {statistics.median(at30)}


@pytest.mark.parametrize("chunk_rows", [1 << 15, 6])
@pytest.mark.parametrize("at_n", [4, 99])
def test_the_early_median_equals_the_late_one(spark, data, chunk_rows, at_n):
    df = data.unionByName(spark.createDataFrame([(None, u, float(u)) for u in range(5)], data.schema))
    options = dict(n_min=2, n_max=5, iters=9, chunk_rows=chunk_rows)
    late = bootstrap.attach_population_median(bootstrap.bootstrap_groups(df, "g", "v", "u", **options), "g", at_n)
    early = bootstrap.bootstrap_with_median(df, "g", "v", "u", at_n=at_n, **options)
    assert early.columns == late.columns
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))


def test_t_ci_by_hand(spark):
    df = spark.createDataFrame([(10.0, 2.0, 4), (1.0, None, 1)], "mean double, sd double, sample_size int")
    r, single = bootstrap.t_ci(df).collect()
    assert r.std_error == 1.0
    assert (r.lower_ci, r.upper_ci) == pytest.approx((10 - 3.182446, 10 + 3.182446), abs=1e-6)
    assert single.error is None and single.lower_ci is None


def test_constant_group_ties_and_voids_its_coverage(data):
    boot = studies.resample_with_ci(data.filter("g = 'b'"), "g", "v", "u", n_min=30, n_max=30, iters=5)
    assert coverage.coverage(boot, "g").collect()[0].prop_correct is None
    assert coverage.coverage(boot, "g", boundary="covered").collect()[0].prop_correct == 1.0


def test_bootstrap_two_is_the_difference_of_two_bootstraps(data):
    one = keyed(bootstrap.bootstrap_groups(data, "g", "v", "u", **GRID))
    two = bootstrap.bootstrap_two(data, "g", "a", "b", "v", "u", **GRID).collect()
    assert len(two) == 8 * 7
    for r in two:
        (m1, s1), (m2, s2) = one["a", r.sample_size, r.iter], one["b", r.sample_size, r.iter]
        assert (r.mean1, r.sd1, r.mean2, r.sd2) == (m1, s1, m2, s2)
        assert r.mean_diff == m1 - m2
        if r.lower_ci is not None:
            assert r.upper_ci - r.lower_ci == pytest.approx(r.width_ci)
            assert r.lower_ci <= r.mean_diff <= r.upper_ci


def test_coverage_is_near_nominal_on_normal_data(spark):
    # 20 groups of 30 normal values, by the quantile function at fixed hash points
    normal = statistics.NormalDist()
    data = [
        (g, u, 5.0 * g + normal.inv_cdf((int(digest("n", g, u)[:12], 16) + 0.5) / 16**12))
        for g in range(20)
        for u in range(30)
    ]
    df = spark.createDataFrame(data, "g int, u int, v double")
    boot = studies.resample_with_ci(df, "g", "v", "u", n_min=30, n_max=30, iters=199)
    point = studies.coverage_curve(boot, "g").collect()[0]
    assert 0.92 <= point.prop_correct <= 0.98
    assert point.lower_ci < point.prop_correct < point.upper_ci
    means = boot.groupBy("g").agg(F.avg("mean").alias("m")).collect()
    for r in means:
        values = [v for g, _, v in data if g == r.g]
        assert abs(r.m - statistics.fmean(values)) < 5 * statistics.stdev(values) / (30 * 199) ** 0.5 * 1.1


def test_large_and_small_groups_agree_on_infinite_values_and_constants(spark):
    inf = float("inf")
    rows = [("x", u, inf if u == 3 else float(u)) for u in range(12)] + [("c", u, 0.1) for u in range(12)]
    rows += [("n", u, None if u == 5 else 1.0 / (u + 1)) for u in range(12)]
    df = spark.createDataFrame(rows, "g string, u int, v double")
    small = keyed(bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=3, n_max=20, iters=9))
    large = keyed(bootstrap.bootstrap_groups(df, "g", "v", "u", n_min=3, n_max=20, iters=9, chunk_rows=2))
    assert {k: str(v) for k, v in small.items()} == {k: str(v) for k, v in large.items()}
    assert {v for k, v in small.items() if k[0] == "c"} == {(0.1, 0.0)}
    means = [v[0] for k, v in small.items() if k[0] == "x"]
    assert inf in means and not any(m != m for m in means)


def test_an_absent_group_is_an_error(data):
    with pytest.raises(Exception, match="has no rows"):
        bootstrap.bootstrap_two(data, "g", "a", "nobody", "v", "u", **GRID).collect()


def test_pairs_equal_single_calls_and_resample_a_group_once(spark):
    data = spark.range(200).selectExpr("id", "concat('g', id % 4) AS g", "sqrt(id) AS v")
    pairs = [("g0", "g1"), ("g2", "g0"), ("g0", "g1")]
    options = dict(n_min=3, n_max=9, iters=11)
    got = bootstrap.bootstrap_pairs(data, "g", pairs, "v", "id", **options)
    table = spark.createDataFrame(pairs, "a string, b string")
    columns = [c for c in got.columns if not c.startswith("group")]
    for a, b in pairs[:2]:
        want = sorted(map(tuple, bootstrap.bootstrap_two(data, "g", a, b, "v", "id", **options).select(*columns).collect()))
        for found in (got, bootstrap.bootstrap_pairs(data, "g", table, "v", "id", **options)):
            assert sorted(map(tuple, found.filter((F.col("group1") == a) & (F.col("group2") == b)).select(*columns).collect())) == want
    assert got.count() == 2 * 7 * 11
    # The data are read as often as for one bootstrap of all groups, so the draws of a group are made once.
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 200")
    assert reads(got) == reads(bootstrap.bootstrap_groups(data, "g", "v", "id", **options)) > 0


def test_pairs_of_unknown_and_absent_groups(spark):
    data = spark.range(60).selectExpr("id", "nullif(concat('g', id % 3), 'g2') AS g", "double(id) AS v")
    options = dict(n_min=3, n_max=4, iters=5)
    got = bootstrap.bootstrap_pairs(data, "g", [("g0", None), ("g1", "g1")], "v", "id", **options).collect()
    assert len(got) == 20 and all(r.mean_diff == 0 for r in got if r.group2 == "g1")
    with pytest.raises(Exception, match="no rows in"):
        bootstrap.bootstrap_pairs(data, "g", [("g0", "g1"), ("x", "y")], "v", "id", **options).collect()


def test_draws_of_large_groups_are_answered_by_arrays(spark):
    """Groups of one, two and many arrays beside each other give what one array each would."""
    data = spark.range(700).selectExpr("id", "CASE WHEN id < 30 THEN 'a' WHEN id < 75 THEN NULL ELSE 'c' END AS g", "sqrt(id) AS v")
    options = dict(n_min=1, n_max=40, iters=7)
    whole = sorted(map(str, bootstrap.bootstrap_groups(data, "g", "v", "id", **options).collect()))
    assert sorted(map(str, bootstrap.bootstrap_groups(data, "g", "v", "id", chunk_rows=32, **options).collect())) == whole


def test_batches_go_on_where_they_stand(spark, tmp_path):
    data = spark.range(240).selectExpr("id", "id % 6 AS g", "sqrt(id) AS v")
    batches, store, options = [[0, 1], [2, 3], [4, 5]], str(tmp_path), dict(n_min=3, n_max=6, iters=9)

    def files():
        return {p.name: p.stat().st_mtime_ns for d in tmp_path.glob("batch-*") for p in d.glob("*.parquet")}

    want = sorted(map(tuple, bootstrap.bootstrap_batches(data, batches, "g", "v", "id", **options).collect()))
    assert sorted(map(tuple, bootstrap.bootstrap_batches(data, batches, "g", "v", "id", store=store, **options).collect())) == want
    before, folders = files(), sorted(tmp_path.glob("batch-*"))
    assert len(folders) == 3 and spark.read.json(f"{store}/manifest").count() == 3
    # A batch that was broken off has no mark of success.
    (folders[1] / "_SUCCESS").unlink()
    lost = {p.name for p in folders[1].glob("*.parquet")}
    again = bootstrap.bootstrap_batches(data, batches, "g", "v", "id", store=store, **options)
    assert sorted(map(tuple, again.collect())) == want
    after = files()
    assert {n: t for n, t in before.items() if n not in lost} == {n: t for n, t in after.items() if n in before and n not in lost}
    assert not lost & set(after) and len(list(tmp_path.glob("batch-*"))) == 3
    # Other data in one batch, or another seed, are other batches; the rest is read.
    changed = data.withColumn("v", F.expr("if(id = 4, 0D, v)"))
    bootstrap.bootstrap_batches(changed, batches, "g", "v", "id", store=store, **options)
    assert len(list(tmp_path.glob("batch-*"))) == 4
    bootstrap.bootstrap_batches(data, batches, "g", "v", "id", store=store, seed=1, **options)
    assert len(list(tmp_path.glob("batch-*"))) == 7
