import os

import pytest

from samplewright.session import build_session, scratch, settle, shared_dir, shuffles_removed


def tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scopes_own_what_is_settled_inside(spark):
    before = tables(spark)
    with scratch(spark) as outer:
        first = settle(spark.range(3))
        with scratch(spark) as inner:
            second = settle(first.selectExpr("id + 1 AS id"))
            kept = inner.keep(second.selectExpr("id * 2 AS id"))
            assert len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 2 and sorted(r.id for r in kept.collect()) == [2, 4, 6]
        result = outer.keep(kept)
    assert len(tables(spark) - before) == 1 and result.count() == 3
    loose = settle(spark.range(2))
    assert len(tables(spark) - before) == 2 and loose.count() == 2


def test_a_failed_scope_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        settle(spark.range(1))
        raise RuntimeError
    assert tables(spark) == before


def test_a_local_session_without_a_folder_uses_its_warehouse(spark, monkeypatch):
    named = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": "/shared/warehouse/"}

    class Conf:
        def get(self, key, *default):
            return named[key]

    class Context:
        master, applicationId = "local[2]", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    assert shared_dir(Session()) == "/shared/warehouse/samplewright-app"
    Context.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
    assert callable(build_session)


def test_the_setting_of_shuffles_comes_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), shuffles_removed(spark):
        assert spark.conf.get(name) == "true" and settle(spark.range(9).groupBy("id").count()).count() == 9
        raise RuntimeError
    assert spark.conf.get(name) == before and name not in spark.conf.getAll
    spark.conf.set(name, "true")
    try:
        with shuffles_removed(spark):
            pass
        assert spark.conf.get(name) == "true"
    finally:
        spark.conf.unset(name)
