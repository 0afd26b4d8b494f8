import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from samplewright.operators import ordering, reshape
from samplewright.plans import studies
from samplewright.session import clear_scratch, shared_dir
from samplewright.sources import files

WIDE_BAD = "rep;A b;C d\n1;1,5;2,25\n2;x;\n3;1.000,5;3\n4;NA;-0,125\n"


def wide(spark, reps, groups=3):
    data = [(r, *[float(100 * g + r) for g in range(groups)]) for r in range(1, reps + 1)]
    return spark.createDataFrame(data, ["rep", *[f"g{g}" for g in range(groups)]])


def test_decimal_comma(spark, tmp_path):
    path = tmp_path / "wide_bad.csv"
    path.write_text(WIDE_BAD)
    got = files.read_csv_decimal_comma(spark, str(path), "rep int, `A b` double, `C d` double")
    assert [tuple(r) for r in got.collect()] == [
        (1, 1.5, 2.25), (2, None, None), (3, 1000.5, 3.0), (4, None, -0.125)
    ]


def test_text_columns_and_big_whole_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("class;n;x\nbeetle a.b,c;1.200;1e-3\n;;\n")
    got = files.read_csv_decimal_comma(spark, str(path), "class string, n int, x double").collect()
    assert tuple(got[0]) == ("beetle a.b,c", 1200, 0.001) and tuple(got[1]) == (None, None, None)


def test_csv_and_stage_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.25), ("b", None, None), (None, 3, -0.5)], "g string, n int, v double")
    expected = sorted(map(str, df.collect()))
    for i, (format, by) in enumerate([("parquet", None), ("parquet", "g"), ("csv", None), ("csv", "g")]):
        got = files.stage(df, str(tmp_path / str(i)), format, by)
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == expected
    assert sorted(map(str, files.stage(df).collect())) == expected
    with pytest.raises(ValueError):
        files.stage(df, format="csv")
    with pytest.raises(ValueError):
        files.stage(df, str(tmp_path / "x"), format="orc")


def test_staged_filters_and_columns_reach_the_scan(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 2 AS v", "id % 2 AS w")
    plan = files.stage(df, str(tmp_path / "t")).filter("v > 6").select("id")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "GreaterThan(v,6)" in text and "ReadSchema: struct<id:bigint,v:bigint>" in text


def test_shared_dir_is_the_one_named_by_the_session(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Sample Size", "sample_size"), ("sampleSize", "sample_size"), ("Tmax (°C)", "tmax_c"),
        ("% above", "percent_above"), ("#n", "number_n"), ("1st", "x1st"), ("Größe", "grosse"), ("", "x"), ("É", "e"),
        ("already_clean", "already_clean"), ("Error.measure", "error_measure"),
    ],
)
def test_clean_name(raw, clean):
    assert reshape.clean_name(raw) == clean


def test_clean_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "A.B", "aB_2"])
    assert reshape.clean_names(df).columns == ["a_b", "a_b_2", "a_b_2_2"]


def test_coerce_numeric_over_a_range_of_columns(spark):
    df = spark.createDataFrame([("1", "2.5", "x", "9"), (None, "", "1e3", "9")], ["a", "b", "c", "d"])
    got = reshape.coerce_numeric(df, "b", "c")
    assert [t for _, t in got.dtypes] == ["string", "double", "double", "string"]
    assert [tuple(r) for r in got.collect()] == [("1", 2.5, None, "9"), (None, None, 1000.0, "9")]
    with pytest.raises(ValueError):
        reshape.coerce_numeric(df, "c", "b")


def long(df):
    return reshape.wide_to_long(df, "rep", "g", "v", None)


def test_recycled_filter_equals_the_range_on_multiples_only(spark):
    for reps, same in ((60, True), (45, False)):
        df = wide(spark, reps)
        kept = reshape.wide_to_long(df, "rep", "g", "v", 30)
        recycled = reshape.filter_recycled(long(df), "rep", list(range(1, 31)), ["g", "rep"])
        expected = [
            (r, f"g{g}") for i, (g, r) in enumerate((g, r) for g in range(3) for r in range(1, reps + 1)) if r == i % 30 + 1
        ]
        assert sorted((r.rep, r.g) for r in recycled.collect()) == sorted(expected)
        assert (sorted(map(str, kept.collect())) == sorted(map(str, recycled.collect()))) is same


def test_wide_to_long_drops_incomplete_rows(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (31, 5.0, 6.0)], "rep int, a double, b double")
    assert sorted(map(tuple, reshape.wide_to_long(df).collect())) == [(1, "a", 1.0), (2, "b", 4.0)]


def test_exclude_groups_keeps_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    assert sorted(str(r.g) for r in reshape.exclude_groups(df, "g", ["a"]).collect()) == ["None", "b"]
    denied = spark.createDataFrame([("a",)], "x string")
    assert sorted(str(r.g) for r in reshape.exclude_groups(df, "g", denied).collect()) == ["None", "b"]


def test_levels_are_coded_per_column(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None)], "p string, q string")
    assert sorted(map(tuple, reshape.levels(df, "p", "q").collect())) == [("p", "a", 1), ("p", "b", 2), ("q", "x", 1)]


def test_crossing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "g int")
    got = reshape.crossing(df, n=(3, 4), i=(1, 3)).collect()
    assert len(got) == len(set(got)) == 2 * 2 * 3


def test_nest_unnest_round_trip(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(25)], "g string, u int, v double")
    chunked = ordering.shuffle_rank(df, "g", "u").withColumn("chunk", F.expr("(ordinal - 1) div 10"))
    nested = reshape.nest(chunked, "g", "chunk")
    assert sorted(len(r.data) for r in nested.collect()) == [5, 10, 10]
    back = reshape.unnest(nested).select("g", "u", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_group_and_table_stats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "g string, v int")
    got = sorted(map(str, (tuple(r) for r in reshape.add_group_stats(df, "g", m=F.avg("v")).collect())))
    assert got == ["('a', 1, 2.0)", "('a', 3, 2.0)", "(None, 5, 5.0)"]
    whole = reshape.add_table_stats(df, n=F.count(F.lit(1)), top=F.max("v"))
    assert whole.columns == ["g", "v", "n", "top"]
    assert {(r.n, r.top) for r in whole.collect()} == {(3, 5)}


def test_first_row_per_group(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 9), ("a", 2, 3), ("b", None, 7)], "g string, o int, u int")
    got = sorted(map(tuple, reshape.first_row_per_group(df, "g", ["o", "u"]).collect()))
    assert got == [("a", 2, 3), ("b", None, 7)]


def test_kth_row(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 7)], "g string, v int")
    assert [tuple(r) for r in reshape.kth_row_per_group(df, "g", "v", 2).collect()] == [("a", 2)]
    assert [tuple(r) for r in reshape.kth_row_per_group(df, None, "v", 4).collect()] == [("b", 7)]


@pytest.mark.parametrize("k", [1, 3, 700, 1400, 5000])
def test_any_kth_row_by_selection(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), rng.randint(0, 9)) for _ in range(2000)]
    rows += [("a", 7, 7)] * 1500  # rows that cannot be told apart
    df = spark.createDataFrame(rows, "g string, v int, u int")
    end = lambda x: (x is None, x or 0)
    for by in ("g", None):
        groups = {}
        for r in sorted(rows, key=lambda r: (end(r[1]), end(r[2]), end(r[0]) if not by else 0)):
            groups.setdefault(r[0] if by else 0, []).append(r)
        order = ["v", "u"] if by else ["v", "u", "g"]
        got = [tuple(r) for r in ordering.select_kth(df, by, order, k).collect()]
        assert sorted(map(str, got)) == sorted(str(x[k - 1]) for x in groups.values() if len(x) >= k)


def test_kth_row_changes_its_way_at_depth_not_its_row(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id * 7919 % 5003 AS v")
    want = sorted(map(tuple, reshape.kth_row_per_group(df, "g", "v", 900).collect()))
    monkeypatch.setattr(reshape, "SHALLOW", 10)
    assert sorted(map(tuple, reshape.kth_row_per_group(df, "g", "v", 900).collect())) == want and len(want) == 3


def test_group_stats_of_heavy_and_light_groups(spark, monkeypatch):
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN -1 ELSE id END AS g", "id AS v")
    few = reshape.add_group_stats(df, "g", n=F.count(F.lit(1)), top=F.max("v"))
    monkeypatch.setattr(reshape, "FEW_GROUPS", 100)
    many = reshape.add_group_stats(df, "g", n=F.count(F.lit(1)), top=F.max("v"))
    assert many.columns == ["g", "v", "n", "top"] and "Union" in many._jdf.queryExecution().toString()
    end = lambda x: (x.g is None, x.g or 0, x.v)
    rows = sorted(many.collect(), key=end)
    assert rows == sorted(few.collect(), key=end) and len(rows) == 6000
    assert {r.n for r in rows if r.g is None or r.g == -1} == {2000}
    assert reshape.add_group_stats(df.limit(0), "g", n=F.count(F.lit(1))).count() == 0


def test_the_cleaning_study(spark, tmp_path):
    text = "rep;Species one;Species two;Bad one\n" + "".join(f"{r};{r},5;-{r},25;oops\n" for r in range(1, 41))
    path = tmp_path / "raw.csv"
    path.write_text(text)
    raw = files.read_csv_decimal_comma(
        spark, str(path), "rep int, `Species one` double, `Species two` double, `Bad one` double"
    )
    got = studies.clean_measurements(raw, "species_one", "bad_one", ["bad_one"]).collect()
    assert len(got) == 60
    for g in ("species_one", "species_two"):
        assert sorted(r.ordinal for r in got if r.group == g) == list(range(1, 31))
    assert sorted(r.value for r in got if r.group == "species_one") == [r + 0.5 for r in range(1, 31)]


def test_scratch_can_be_cleared(spark):
    files.stage(spark.range(3))
    assert os.listdir(shared_dir(spark))
    clear_scratch(spark)
    assert not os.path.exists(shared_dir(spark))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    context = spark.sparkContext
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="x"),
    )
    with pytest.raises(ValueError):
        shared_dir(fake)
    fake.sparkContext.getCheckpointDir = context.getCheckpointDir
    assert shared_dir(fake).startswith(context.getCheckpointDir())


def test_null_is_excluded_where_it_is_named(spark):
    df = spark.createDataFrame([(1,), (7,), (None,)], "g int")
    left = lambda names: sorted((r.g for r in reshape.exclude_groups(df, "g", names).collect()), key=str)
    assert left([7]) == [1, None] and left([None, 7]) == [1] and left([None]) == [1, 7] and left([]) == [1, 7, None]
    assert left(spark.createDataFrame([(None,), (7,)], "x int")) == [1]
