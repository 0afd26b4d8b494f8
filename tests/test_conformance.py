"""Every query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as driver
from samplewright.conformance.compare import connect, differences
from samplewright.conformance.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_keys_agree():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, name) == []


def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["sample_size", "prop_correct", "lower_ci", "upper_ci"]
    assert got.count() == 48
