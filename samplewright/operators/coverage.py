"""How often a resample's interval holds the population parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.normal import wilson
from samplewright.functions.nulls import ratio, strict
from samplewright.operators.ordering import columns


def hit_flag(
    df: DataFrame,
    param: str = "median_pop_val",
    lo: str = "lower_ci",
    hi: str = "upper_ci",
    boundary: str = "null",
    name: str = "ci_falls",
) -> DataFrame:
    """1.0 if the parameter is inside the interval, 0.0 if outside.

    A parameter equal to a bound is in neither case: NULL by default, or a hit with
    ``boundary="covered"``.
    """
    if boundary not in ("null", "covered"):
        raise ValueError("boundary must be 'null' or 'covered'")
    p, lower, upper = F.col(param), F.col(lo), F.col(hi)
    inside = (p > lower) & (p < upper) if boundary == "null" else (p >= lower) & (p <= upper)
    return df.withColumn(name, F.when((p < lower) | (p > upper), 0.0).when(inside, 1.0))


def coverage(
    df: DataFrame,
    g: str,
    n: str = "sample_size",
    it: str = "iter",
    param: str = "median_pop_val",
    lo: str = "lower_ci",
    hi: str = "upper_ci",
    boundary: str = "null",
) -> DataFrame:
    """Coverage per group and size: ``n_correct, max_n, prop_correct``.

    One NULL flag makes the count, and so the share, of that group and size NULL.
    """
    flagged = hit_flag(df, param, lo, hi, boundary, "_hit")
    counted = flagged.groupBy(g, n).agg(
        strict(F.sum, "_hit").alias("n_correct"), strict(F.max, it).alias("max_n")
    )
    return counted.withColumn("prop_correct", ratio("n_correct", "max_n"))


def wilson_ci(df: DataFrame, x: str = "n_correct", n: str = "max_n", level: float = 0.95) -> DataFrame:
    """Add the Wilson interval of ``x`` out of ``n`` as the columns ``point, lower, upper``."""
    return df.withColumn("_ci", wilson(x, n, level)).select(*df.columns, "_ci.*")


def coverage_ci(
    covered: DataFrame, g: str, n: str = "sample_size", level: float = 0.95
) -> DataFrame:
    """Coverage with its binomial interval: ``g, n, prop_correct, lower_ci, upper_ci``."""
    return wilson_ci(covered, level=level).select(
        g,
        n,
        F.col("point").alias("prop_correct"),
        F.col("lower").alias("lower_ci"),
        F.col("upper").alias("upper_ci"),
    )


def pooled_curve(df: DataFrame, by: str = "sample_size", cols: Sequence[str] | str = ("prop_correct", "lower_ci", "upper_ci")) -> DataFrame:
    """Unweighted mean over groups of each column, per size; NULL if a group's is NULL."""
    return df.groupBy(by).agg(*[strict(F.avg, c).alias(c) for c in columns(cols)])
