"""Session defaults, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under (UTC, ANSI on, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("samplewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Only a local session may be without one; its warehouse stands in.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/samplewright-{context.applicationId}"


class Scratch:
    """Owner of the tables settled while it is open; see :func:`scratch`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, owner: Scratch | None = None) -> DataFrame:
        """Store a result beyond this scope: it belongs to ``owner``, or to the scope around, if there is one."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        outer = [owner] if owner else _open()[: _open().index(self)]
        if outer:
            outer[-1].paths.append(path)
        return _stored(df, path)

    def close(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


_scopes = threading.local()


def _open() -> list[Scratch]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope for intermediate tables: what is settled inside is deleted when it ends, whether it fails or not.

    A result outlives it through ``keep``, which stores it; a DataFrame that was not kept cannot be read afterwards, as
    the tables behind it are gone. Scopes may be nested.
    """
    scope = Scratch(spark)
    _open().append(scope)
    try:
        yield scope
    finally:
        _open().remove(scope)
        scope.close()


def scratch_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _open():
        _open()[-1].paths.append(path)
    return path


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a value such as a partition number is not stable under recomputation:
    afterwards it is stored data, lost executors cannot change it, and later reads
    prune columns. The table belongs to the innermost open :func:`scratch`.
    """
    return _stored(df, scratch_path(df.sparkSession))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it is open, shuffle files of a query are deleted when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path of the cluster's file systems, and the file system it is on."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, path: str) -> None:
    fs, found = _path(spark, path)
    fs.delete(found, True)


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, found = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(found)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has settled. Call it once its results are stored."""
    remove(spark, shared_dir(spark))
