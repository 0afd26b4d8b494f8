"""Order-dependent operators that never put a whole table or group in one task.

A window over ``partitionBy(group)`` gives a hot group to a single task, and one
without ``partitionBy`` gives it the whole table. Here rows are first cut into buckets
that respect the wanted order (ranges of a hash for random orders, sampled ranges for
given orders). Positions inside a bucket come from a window on (group, bucket), and only
the per-bucket totals are accumulated across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.functions.hashing import order_key, slice_of
from samplewright.functions.nulls import null_safe, quoted
from samplewright.session import settle, shuffle_partitions

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def columns(c: str | Sequence[str] | None) -> list[str]:
    if c is None:
        return []
    return [c] if isinstance(c, str) else list(c)


def _ascending(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def _ascending_sql(cols: Sequence[str]) -> str:
    return ", ".join(f"{quoted(c)} ASC NULLS LAST" for c in cols)


def _tie_break(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """A hash of the other columns, as SQL text: spreads rows that tie in ``keys``.

    It depends on content alone, so recomputed rows go where they went before.
    """
    other = [f.name for f in df.schema if f.name not in keys and "map<" not in f.dataType.simpleString()]
    return [f"xxhash64({', '.join(map(quoted, other))})"] if other else []


def _accumulate(df: DataFrame, order: str, weight: str, start: str, total: str) -> DataFrame:
    """Add the weight before each row in its group, and the group's weight.

    ``df`` holds the group in ``_key`` and an order-respecting bucket in ``_bucket``.
    The rows are shuffled once, on (_key, _bucket); the totals have one row per pair
    and at most one bucket count per group.
    """
    sums = df.groupBy("_key", "_bucket").agg(F.expr(f"sum({weight}) AS _sum"))
    offsets = sums.selectExpr(
        "_key",
        "_bucket",
        "coalesce(sum(_sum) OVER (PARTITION BY _key ORDER BY _bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset",
        f"sum(_sum) OVER (PARTITION BY _key) AS {quoted(total)}",
    )
    inside = df.selectExpr(
        "*",
        f"sum({weight}) OVER (PARTITION BY _key, _bucket ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _running",
    )
    return inside.join(offsets, ["_key", "_bucket"]).selectExpr(
        "* EXCEPT (_key, _bucket, _running, _offset)", f"_offset + _running - {weight} AS {quoted(start)}"
    )


def shuffle_rank(
    df: DataFrame,
    g: str | Sequence[str],
    unit: str | Sequence[str],
    seed: int = 2012,
    rng: str = "xxhash64",
    name: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """Randomly permute every group and number its rows 1..n.

    The order is that of a hash of (seed, group, unit), so it depends on the data only.
    ``unit`` names the columns that identify a row inside its group; rows that share a unit are ordered by a hash of
    their other columns, so that they too keep their places when a task is run again. ``total``, if given, names a
    column for the group size.
    """
    g, unit = columns(g), columns(unit)
    ties = _tie_break(df, g + unit)
    key = order_key(rng, seed, *map(quoted, g + unit))
    keyed = df.selectExpr("*", f"{null_safe(*g)} AS _key", f"{key} AS _hash").selectExpr(
        "*", f"{slice_of(rng, '_hash', shuffle_partitions(df.sparkSession))} AS _bucket"
    )
    placed = _accumulate(keyed, ", ".join(["_hash", _ascending_sql(unit), *ties]), "1", "_start", total or "_total")
    return placed.selectExpr(
        *map(quoted, df.columns), f"_start + 1 AS {quoted(name)}", *([quoted(total)] if total else [])
    )


def weighted_start(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    weight: str = "1",
    start: str = "start",
    total: str = "total",
) -> DataFrame:
    """For every row, the weight that precedes it in its group, and the group's weight.

    ``weight`` is SQL text. Rows are range-partitioned on (by, order), which splits a hot
    group; ties are split by their other columns, and many identical rows should be
    counted first and weighted. The partition number is stored before use.
    """
    by, order = columns(by), columns(order)
    parts = shuffle_partitions(df.sparkSession)
    ties = _tie_break(df, by + order)
    ranged = df.repartitionByRange(parts, *_ascending(by + order), *map(F.expr, ties))
    ranged = settle(ranged.withColumn("_bucket", F.spark_partition_id()))
    keyed = ranged.selectExpr("*", f"{null_safe(*by)} AS _key")
    placed = _accumulate(keyed, ", ".join([_ascending_sql(order), *ties]), weight, start, total)
    return placed.selectExpr(*map(quoted, [*df.columns, start, total]))


def group_row_number(
    df: DataFrame, by: str | Sequence[str] | None, order: str | Sequence[str], name: str = "row_number"
) -> DataFrame:
    """Row number 1..n inside each group, in the given order."""
    placed = weighted_start(df, by, order, start="_start", total="_total")
    return placed.select(*df.columns, (F.col("_start") + 1).cast("long").alias(name))


def select_kth(df: DataFrame, by: str | Sequence[str] | None, order: str | Sequence[str], k: int) -> DataFrame:
    """Row ``k`` (from 1) of each group, or of the table, for any ``k``; groups with fewer rows give none.

    Rows are range-partitioned on (by, order) and counted by (group, range); the counts tell which range of a group holds
    its row ``k``, and only these ranges are sorted. Rows equal in all columns are counted first, as no range could split them.
    """
    by, order = columns(by), columns(order)
    ties = _tie_break(df, by + order)
    if any("map<" in f.dataType.simpleString() for f in df.schema):
        counted = df.withColumn("_n", F.lit(1).cast("long"))
    else:
        counted = df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.repartitionByRange(shuffle_partitions(df.sparkSession), *_ascending(by + order), *map(F.expr, ties))
    ranged = settle(ranged.withColumn("_bucket", F.spark_partition_id()))
    keyed = ranged.selectExpr("*", f"{null_safe(*by)} AS _key")
    sizes = keyed.groupBy("_key", "_bucket").agg(F.sum("_n").alias("_rows"))
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    holding = sizes.select("_key", "_bucket", "_rows", before.alias("_before")).filter(
        (F.col("_before") < k) & (F.col("_before") + F.col("_rows") >= k)
    )
    running = f"sum(_n) OVER (PARTITION BY _key, _bucket ORDER BY {', '.join([_ascending_sql(order), *ties])} " + (
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    inside = keyed.join(holding.drop("_rows"), ["_key", "_bucket"]).selectExpr("*", f"_before + {running} AS _upto")
    return inside.filter((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)).select(*map(quoted, df.columns))


def row_index(df: DataFrame, order: str | Sequence[str], name: str = "row_index") -> DataFrame:
    """Dense 0-based position of every row in the whole table.

    One range shuffle and a local sort. Partition and row number are stored together,
    so only one count per partition has to be accumulated.
    """
    order = columns(order)
    keys = _ascending(order) + [F.expr(t) for t in _tie_break(df, order)]
    parts = shuffle_partitions(df.sparkSession)
    sorted_rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = settle(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.select(
        *df.columns,
        F.shiftright("_id", ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )
    counts = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the sort, so at most `parts` rows are broadcast.
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_row") + F.col("_offset")).alias(name)
    )


def _last_value(c: str, order: Sequence[str]) -> Column:
    """The value of ``c`` in the last row of a group, NULLs of the order last."""
    if len(order) == 1:
        # Scalar buffers keep this a hash aggregate.
        unknown = F.max(F.when(F.col(order[0]).isNull(), F.col(c)))
        known = F.count(order[0]) == F.count(F.lit(1))
        return F.when(known, F.max_by(c, order[0])).otherwise(unknown)
    return F.max_by(c, F.struct(*[x for o in order for x in (F.col(o).isNull(), F.col(o))]))


def _lag_over_ranges(df: DataFrame, c: str, order: Sequence[str], name: str) -> DataFrame:
    keys = _ascending(order) + [F.expr(t) for t in _tie_break(df, order)]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = settle(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", ROW_BITS))
    inside = placed.withColumn("_before", F.lag(F.struct(F.col(c).alias("v"))).over(W.partitionBy("_part").orderBy("_id")))
    # One row per partition of the sort.
    ends = placed.groupBy("_part").agg(F.max_by(F.struct(F.col(c).alias("v")), "_id").alias("_end"))
    carried = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_end"))
    joined = inside.join(F.broadcast(carried), "_part")
    return joined.select(*df.columns, F.coalesce("_before", "_end")["v"].alias(name))


def global_lag(
    df: DataFrame,
    c: str,
    order: Sequence[str],
    part: str | Sequence[str] | None = None,
    name: str = "lagged",
) -> DataFrame:
    """The value of ``c`` in the previous row of the whole table in ``order``.

    Rows are cut into ranges of ``order``, whatever the keys in it, so a hot key is spread; the last value of each
    range is carried to the next. ``part``, a leading part of ``order`` under which few rows share a value, saves the
    stored copy: for resamples it is (group, size), which holds one row per iteration. Each part then gets a copy of
    the last row of the part before it, sorted first and dropped again after the lag, so rows are shuffled once and no
    join touches them.
    """
    order = list(order)
    part = columns(part)
    if not part:
        return _lag_over_ranges(df, c, order, name)
    rest = order[len(part) :]
    if order[: len(part)] != part or not rest:
        raise ValueError("part must be a proper prefix of order")
    tails = df.groupBy(*part).agg(_last_value(c, rest).alias("_tail"))
    indexed = row_index(tails, part, "_index")
    carried = (
        indexed.select((F.col("_index") + 1).alias("_index"), F.col("_tail").alias(c))
        .join(indexed.select("_index", *part), "_index")
        .drop("_index")
        .withColumn("_carried", F.lit(True))
    )
    both = df.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*part).orderBy(F.col("_carried").desc(), *_ascending(rest))
    return (
        both.withColumn(name, F.lag(c).over(inside))
        .filter(~F.col("_carried"))
        .select(*df.columns, name)
    )


def exact_median(df: DataFrame, c: str, by: str | Sequence[str] | None = None, name: str = "median") -> DataFrame:
    """Exact median of the known values of ``c``, per group or of the whole table.

    The built-in exact percentile keeps all distinct values of a group in one task.
    Here values are counted first and then located by accumulated count.
    """
    by = columns(by)
    counted = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
    placed = weighted_start(counted, by, c, "_n", "_start", "_total")
    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda target: (
        (F.col("_start") <= target) & (target < F.col("_start") + F.col("_n"))
    ).cast("int")
    hits = holds(lower) + holds(upper)
    return (
        placed.withColumn("_hits", hits)
        .filter(F.col("_hits") > 0)
        .groupBy(*by)
        .agg((F.sum(F.col(c).cast("double") * F.col("_hits")) / F.lit(2.0)).alias(name))
    )
