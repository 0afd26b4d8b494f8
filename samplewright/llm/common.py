"""What several operators share: row keys, tables read by name, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.operators.ordering import row_index
from samplewright.session import settle

KEY = "_doc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` as (``_doc``, ``row``): a unique integer key that sorts as the id, and the whole row.

    The row is kept as a struct, so no column name of the caller can clash. Unique whole-number ids are
    their own keys. With repeated or NULL ids, or ids that are no integers, the rows are stored once with
    a row number, as only then a lost executor cannot deal the keys anew; the key is then the position
    in (id, row number) order, NULLs last.
    """
    kind = dict(docs.dtypes)[doc_id]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        twice = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(doc_id).isNull())
        if twice.isEmpty():
            return docs.select(F.col(doc_id).cast("long").alias(KEY), F.struct("*").alias("row"))
    stored = settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_n")))
    order = row_index(stored.select(F.col(f"row.{doc_id}").alias("_id"), "_n"), ["_id", "_n"], KEY)
    return stored.join(order.select("_n", KEY), "_n").select(KEY, "row")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Alternates the large-star and the small-star step of Kiveris et al. (2014) until nothing changes. Each
    round is stored in the shared folder, so the lineage stays short and a lost executor costs one round.
    """
    spark = edges.sparkSession
    e = settle(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if e.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        small = hooked.select("u", "m").union(hooked.filter("v != m").select("v", "m"))
        e = settle(small.toDF("u", "v").filter("u != v").distinct())
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select("v", "v").distinct())
