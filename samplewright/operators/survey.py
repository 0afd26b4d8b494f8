"""Descriptive tables over a literature survey."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.nulls import null_safe, ratio
from samplewright.operators.ordering import columns, exact_median


def split_by_metric(
    df: DataFrame, class_col: str, keep: str, metric_col: str, metric: str, cols: Sequence[str]
) -> DataFrame:
    """Records of one class that report one metric, reduced to ``cols``."""
    return df.filter((F.col(class_col) == keep) & (F.col(metric_col) == metric)).select(*cols)


def known_count(df: DataFrame, c: str, name: str = "n_known") -> DataFrame:
    """Number of records in which ``c`` is known, as a one-row table."""
    return df.agg(F.count(c).alias(name))


def distribution_summary(df: DataFrame, c: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """``median, min, max, sd, nn, se`` of the known values."""
    by = columns(by)
    known = df.filter(F.col(c).isNotNull())
    stats = known.groupBy(*by).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("sd"), F.count(c).alias("nn")
    )
    medians = exact_median(df, c, by)
    if by:
        keyed = medians.selectExpr(f"{null_safe(*by)} AS _key", "median")
        stats = stats.selectExpr("*", f"{null_safe(*by)} AS _key").join(keyed, "_key")
    else:
        stats = stats.withColumn("median", medians.select(F.max("median")).scalar())
    return stats.withColumn("se", ratio("sd", F.sqrt("nn"))).select(
        *by, "median", "min", "max", "sd", "nn", "se"
    )


def share_above(
    df: DataFrame, c: str, thresholds: Sequence[float], by: str | Sequence[str] | None = None
) -> DataFrame:
    """Count and share of the known values above each threshold; one pass for all."""
    by = columns(by)
    counted = df.groupBy(*by).agg(
        F.count(c).alias("n_known"),
        *[F.count(F.when(F.col(c) > t, 1)).alias(f"_above{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_above{i}").alias("n_above"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counted.select(*by, "n_known", F.inline(rows)).withColumn("prop_above", ratio("n_above", "n_known"))


def histogram(
    df: DataFrame,
    c: str,
    width: float = 5,
    center: float = 1,
    lo: float = 0,
    hi: float = 70,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Fixed-width histogram: ``bin, bin_center, bin_lower, bin_upper, frequency``.

    One bin is centred on ``center``; bins are open on the left and closed on the right,
    except that the lowest also holds its left edge. Values outside ``lo .. hi`` are
    dropped, empty bins are kept, and so are groups without a value inside. Only one row per group and bin is ever
    collected.
    """
    by = columns(by)
    edge = center - width / 2.0
    first = math.floor((lo - edge) / width) + 1
    last = max(first, math.ceil((hi - edge) / width))
    of = F.ceil((F.col(c) - F.lit(edge)) / F.lit(float(width))).cast("int")
    inside = F.col(c).between(lo, hi)
    counted = df.groupBy(*by, F.when(inside, F.greatest(of, F.lit(first))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))  # NULLs are not collected
    filled = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_counts"))
    dense = filled.select(*by, "_counts", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("bin"))
    upper = F.col("bin") * F.lit(float(width)) + F.lit(edge)
    return dense.select(
        *by,
        "bin",
        (upper - F.lit(width / 2.0)).alias("bin_center"),
        (upper - F.lit(float(width))).alias("bin_lower"),
        upper.alias("bin_upper"),
        F.coalesce(F.try_element_at("_counts", "bin"), F.lit(0)).cast("long").alias("frequency"),
    )
