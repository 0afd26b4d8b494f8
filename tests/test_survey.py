import statistics

import pytest

from samplewright.operators import survey
from samplewright.plans import studies

N = [-1, 0, 1, 3, 4, 8, 70, 71, None]


@pytest.fixture
def lit(spark):
    data = [("beetles", "upper" if i % 2 else "lower", n, float(i)) for i, n in enumerate(N)]
    return spark.createDataFrame([*data, ("birds", "upper", 5, 1.0), (None, "upper", 5, 1.0)], "class string, metric string, n int, t double")


def test_split_drops_unknown_classes(lit):
    got = survey.split_by_metric(lit, "class", "beetles", "metric", "upper", ["n", "t"])
    assert got.columns == ["n", "t"] and got.count() == 4


def test_histogram_is_closed_on_the_right(spark):
    df = spark.createDataFrame([(n,) for n in [*N, 3, 68, 69]], "n int")
    got = {r.bin_center: r for r in survey.histogram(df, "n").collect()}
    assert sorted(got) == [1.0 + 5 * i for i in range(15)]
    assert (got[1.0].bin_lower, got[1.0].bin_upper) == (-1.5, 3.5)
    counts = {c: r.frequency for c, r in got.items() if r.frequency}
    assert counts == {1.0: 4, 6.0: 2, 66.0: 1, 71.0: 2}
    edge = spark.createDataFrame([(3.5,), (3.5000001,)], "n double")
    assert {r.bin: r.frequency for r in survey.histogram(edge, "n").collect() if r.frequency} == {1: 1, 2: 1}


def test_histogram_starting_on_an_edge_holds_it(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,)], "n double")
    got = {r.bin_lower: r.frequency for r in survey.histogram(df, "n", 5, 2.5, 0, 10).collect()}
    assert got == {0.0: 2, 5.0: 1}


def test_distribution_and_shares(lit):
    known = [n for n in N if n is not None] + [5, 5]
    r = survey.distribution_summary(lit, "n").collect()[0]
    assert (r["median"], r["min"], r["max"], r.nn) == (statistics.median(known), -1, 71, 10)
    assert r.sd == pytest.approx(statistics.stdev(known)) and r.se == pytest.approx(r.sd / 10**0.5)
    assert survey.known_count(lit, "n").collect()[0].n_known == 10
    got = {s.threshold: (s.n_above, s.prop_above) for s in survey.share_above(lit, "n", [3, 100]).collect()}
    assert got == {3.0: (6, 0.6), 100.0: (0, 0.0)}


def test_by_group_keeps_unknown_groups(lit):
    got = {r["class"]: r["median"] for r in survey.distribution_summary(lit, "n", "class").collect()}
    assert got == {"beetles": statistics.median([n for n in N if n is not None]), "birds": 5.0, None: 5.0}


def test_survey_tables(lit):
    tables = studies.survey_tables(lit, "class", "beetles", {"upper": ("metric", "t"), "lower": ("metric", "t")})
    assert tables["upper"]["known"].collect()[0].n_known == 4
    assert tables["lower"]["known"].collect()[0].n_known == 4
    assert tables["lower"]["distribution"].collect()[0].nn == 4
    assert tables["upper"]["shares"].count() == 2 and tables["lower"]["histogram"].count() == 15


def test_a_group_without_values_inside_keeps_its_empty_bins(spark):
    df = spark.createDataFrame([("a", 5), ("b", 500), ("c", None)], "g string, n int")
    got = survey.histogram(df, "n", by="g").groupBy("g").agg({"frequency": "sum", "bin": "count"}).collect()
    assert {r.g: (r["sum(frequency)"], r["count(bin)"]) for r in got} == {"a": (1, 15), "b": (0, 15), "c": (0, 15)}
