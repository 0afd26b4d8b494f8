"""Queries that SQL can express, against their SQL."""

from collections import Counter

import duckdb
import pytest

from samplewright.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF_DIR)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    rows = Counter(tuple(r) for r in got.select(*order).collect())
    assert rows == Counter(want.select(*order).fetchall())
