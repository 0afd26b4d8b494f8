"""Cleaning and reshaping of wide measurement tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.operators.ordering import columns, row_index, select_kth
from samplewright.session import settle, shuffle_partitions

# Few enough rows of aggregates to broadcast, and few enough rows for a window to keep of each group in every task.
FEW_GROUPS = 10_000
SHALLOW = 1_000


def clean_name(name: str) -> str:
    """Lower snake_case ASCII form of one column name."""
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = unicodedata.normalize("NFKD", name.replace("ß", "ss")).encode("ascii", "ignore").decode()
    name = re.sub(r"['\"]", "", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() or "x"
    return f"x{name}" if name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Normalise column names; repeats get the suffixes _2, _3, ... Metadata only."""
    names: list[str] = []
    for base in map(clean_name, df.columns):
        name, i = base, 1
        while name in names:
            i += 1
            name = f"{base}_{i}"
        names.append(name)
    return df.toDF(*names)


def coerce_numeric(df: DataFrame, first: str, last: str) -> DataFrame:
    """Cast the adjacent columns ``first .. last`` to double; bad text becomes NULL."""
    start, stop = df.columns.index(first), df.columns.index(last)
    if start > stop:
        raise ValueError(f"{first} comes after {last}")
    chosen = set(df.columns[start : stop + 1])
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in chosen else F.col(c) for c in df.columns])


def wide_to_long(
    df: DataFrame, id: str = "rep", names_to: str = "name", values_to: str = "value", max_rep: int | None = 30
) -> DataFrame:
    """Unpivot all other columns, keep the first ``max_rep`` replicates and complete rows."""
    if max_rep is not None:
        df = df.filter(F.col(id).between(1, max_rep))
    measured = [c for c in df.columns if c != id]
    return df.unpivot([id], measured, names_to, values_to).na.drop("any")


def filter_recycled(df: DataFrame, c: str, pattern: Sequence[int], order_by: str | Sequence[str]) -> DataFrame:
    """Keep row ``i`` of the ordered table iff ``c`` equals ``pattern[i mod len(pattern)]``.

    ``order_by`` must order the rows totally. It is a plain "c is in pattern" only
    where every run of rows matches the pattern's length.
    """
    placed = row_index(df, order_by, "_index")
    at = F.pmod(F.col("_index"), F.lit(len(pattern))).cast("int")
    wanted = F.get(F.array(*[F.lit(p) for p in pattern]), at)
    return placed.filter(F.col(c) == wanted).select(*df.columns)


def exclude_groups(df: DataFrame, g: str, names: Sequence[object] | DataFrame) -> DataFrame:
    """Drop the named groups; rows without a group stay unless NULL is named.

    A long deny-list is passed as a one-column table and becomes an anti join.
    """
    if isinstance(names, DataFrame):
        denied = names.select(F.col(names.columns[0]).alias("_denied"))
        return df.join(denied, F.col(g).eqNullSafe(F.col("_denied")), "left_anti")
    known = [x for x in names if x is not None]
    denied = F.coalesce(F.col(g).isin(*known), F.lit(False)) if known else F.lit(False)
    return df.filter(~denied & F.col(g).isNotNull()) if len(known) < len(names) else df.filter(~denied)


def levels(df: DataFrame, *cols: str) -> DataFrame:
    """Sorted distinct values of each string column, with their 1-based ``code``."""
    texts = [F.col(c).cast("string").alias(c) for c in cols]
    distinct = (
        df.select(*texts)
        .unpivot([], list(cols), "column", "level")
        .filter(F.col("level").isNotNull())
        .distinct()
    )
    placed = row_index(distinct, ["column", "level"], "_index")
    starts = placed.groupBy("column").agg(F.min("_index").alias("_start"))
    # One row per argument in `cols`.
    return placed.join(F.broadcast(starts), "column").select(
        "column", "level", (F.col("_index") - F.col("_start") + 1).cast("long").alias("code")
    )


def crossing(df: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Distinct rows of ``df`` with every combination of the given integer ranges."""
    out = df.distinct()
    for name, (low, high) in ranges.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return out


def nest(df: DataFrame, g: str | Sequence[str], chunk: str, name: str = "data") -> DataFrame:
    """Nest the other columns into arrays of structs, one per group and ``chunk``.

    ``chunk`` is a column that bounds the length of an array, see
    :func:`samplewright.operators.ordering.shuffle_rank` for ordinals to divide.
    """
    g = columns(g)
    rest = [c for c in df.columns if c not in (*g, chunk)]
    return df.groupBy(*g, chunk).agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, c: str = "data") -> DataFrame:
    keep = [x for x in df.columns if x != c]
    return df.select(*keep, F.inline(c))


def add_group_stats(df: DataFrame, g: str | Sequence[str], **aggregates: object) -> DataFrame:
    """Aggregates of its group on every row.

    Aggregate and join instead of a window, which would sort a hot group in one task. The aggregates are stored with the
    sizes of the groups. Up to ``FEW_GROUPS`` groups are broadcast. Of more, the heavy ones, with more rows than a shuffle
    partition has on average, are fewer than there are partitions: they are broadcast, and only rows of the others are
    shuffled to their aggregates.
    """
    g = columns(g)
    stats = df.groupBy(*g).agg(*[a.alias(n) for n, a in aggregates.items()], F.count(F.lit(1)).alias("_rows"))
    stats = settle(stats.select(*[F.col(c).alias(f"_{c}") for c in g], *aggregates, "_rows"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in g]
    on = same[0]
    for s in same[1:]:
        on = on & s
    groups, rows = stats.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    named = [*df.columns, *aggregates]
    if groups <= FEW_GROUPS:
        return df.join(F.broadcast(stats), on).select(*named)
    hot = F.col("_rows") > rows // shuffle_partitions(df.sparkSession)
    heavy = F.broadcast(stats.filter(hot))
    light = df.join(heavy, on, "left_anti").join(stats.filter(~hot), on)
    return df.join(heavy, on).select(*named).union(light.select(*named))


def add_table_stats(df: DataFrame, **aggregates: object) -> DataFrame:
    """Whole-table aggregates on every row, from one scalar subquery."""
    totals = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()])).scalar()
    return df.withColumn("_totals", totals).select(*df.columns, "_totals.*")


def kth_row_per_group(
    df: DataFrame, g: str | Sequence[str] | None, order: str | Sequence[str], k: int
) -> DataFrame:
    """Row ``k`` (from 1) of each group, or of the table, in the given order.

    Up to ``SHALLOW`` rows deep, every task drops all but the first ``k`` rows of a group before the shuffle: a limit of
    a window on ``row_number``, or of a sort where there is no group. Deeper rows are found by
    :func:`samplewright.operators.ordering.select_kth`, which sorts one range of each group. Both take the same row but
    for rows that tie in ``order``, of which any may be taken.
    """
    if k > SHALLOW:
        return select_kth(df, g, order, k)
    order = [F.col(c).asc_nulls_last() for c in columns(order)]
    if columns(g):
        numbered = df.withColumn("_number", F.row_number().over(W.partitionBy(*columns(g)).orderBy(*order)))
        return numbered.filter(F.col("_number") <= k).filter(F.col("_number") == k).select(*df.columns)
    first = df.orderBy(*order).limit(k)
    return first.withColumn("_number", F.row_number().over(W.orderBy(*order))).filter(F.col("_number") == k).select(*df.columns)


def first_row_per_group(df: DataFrame, g: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The first row of each group, reduced before the shuffle."""
    g, order = columns(g), columns(order)
    rest = [c for c in df.columns if c not in g]
    key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    first = df.groupBy(*g).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return first.select(*[F.col(c) if c in g else F.col(f"_row.{c}").alias(c) for c in df.columns])
