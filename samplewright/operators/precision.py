"""Width of the confidence interval, and its change from one resample to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions.nulls import clamp_above, ratio, strict
from samplewright.operators.ordering import columns, global_lag


def ci_width(
    df: DataFrame, lo: str = "lower_ci", hi: str = "upper_ci", name: str = "w_ci", absolute: bool = False
) -> DataFrame:
    width = F.col(hi) - F.col(lo)
    return df.withColumn(name, F.abs(width) if absolute else width)


def width_change(
    df: DataFrame, g: str, n: str = "sample_size", it: str = "iter", w: str = "w_ci", name: str = "dw_ci"
) -> DataFrame:
    """Absolute change of ``w`` against the previous row of the table.

    The table is ordered by group, size and iteration, so the first iteration of a size
    is compared with the last one of the size before, across groups too.
    """
    lagged = global_lag(df, w, [g, n, it], [g, n], "_previous")
    return lagged.select(*df.columns, F.abs(F.col(w) - F.col("_previous")).alias(name))


def measure(
    df: DataFrame, g: str, n: str = "sample_size", it: str = "iter", lo: str = "lower_ci", hi: str = "upper_ci"
) -> DataFrame:
    """Width and change of every resample: ``g, n, it, w_ci, dw_ci``.

    The tables below measure a table themselves unless it holds these columns, so a
    caller who wants several of them measures once.
    """
    if {"w_ci", "dw_ci"} <= set(df.columns):
        return df.select(g, n, it, "w_ci", "dw_ci")
    return width_change(ci_width(df.select(g, n, it, lo, hi), lo, hi).drop(lo, hi), g, n, it)


def precision_by_group(
    df: DataFrame, g: str, n: str = "sample_size", it: str = "iter", lo: str = "lower_ci", hi: str = "upper_ci"
) -> DataFrame:
    """Mean width and mean change per group and size.

    The very first row has no change, which makes its group's first mean change NULL.
    """
    return measure(df, g, n, it, lo, hi).groupBy(g, n).agg(
        strict(F.avg, "w_ci").alias("w_ci"), strict(F.avg, "dw_ci").alias("dw_ci")
    )


def pooled_width_se(
    df: DataFrame, g: str, n: str = "sample_size", lo: str = "lower_ci", hi: str = "upper_ci"
) -> DataFrame:
    """Pooled width with a band of one "sd over iterations / sqrt(n)"."""
    per_group = (
        ci_width(df, lo, hi, "_w", absolute=True)
        .groupBy(g, n)
        .agg(strict(F.avg, "_w").alias("_mean"), strict(F.stddev_samp, "_w").alias("_sd"))
        .withColumn("_se", ratio("_sd", F.sqrt(n)))
    )
    pooled = per_group.groupBy(n).agg(
        strict(F.avg, "_mean").alias("mean_p"), strict(F.avg, "_se").alias("mean_se")
    )
    return pooled.withColumn("lower", F.col("mean_p") - F.col("mean_se")).withColumn(
        "upper", F.col("mean_p") + F.col("mean_se")
    )


def _relative_band(measured: DataFrame, g: str, n: str, c: str, width: str, prefix: str) -> DataFrame:
    """Per group mean of ``c`` with a band of "mean / sqrt(n)", then averaged over groups.

    Unknown values are skipped inside a group, and make the pooled value NULL if a whole
    group is unknown. The spread is always that of the width.
    """
    mean, sd = f"{prefix}_mean", f"{prefix}_sd"
    band = ratio(mean, F.sqrt(n))
    per_group = (
        measured.groupBy(g, n)
        .agg(F.avg(c).alias(mean), F.stddev_samp(width).alias(sd))
        .withColumn("lower_se", F.col(mean) - band)
        .withColumn("upper_se", F.col(mean) + band)
    )
    return per_group.groupBy(n).agg(
        *[strict(F.avg, x).alias(x) for x in (mean, sd, "lower_se", "upper_se")]
    )


def pooled_width_rel(
    df: DataFrame, g: str, n: str = "sample_size", lo: str = "lower_ci", hi: str = "upper_ci"
) -> DataFrame:
    """Pooled width with a band of "mean / sqrt(n)", and ``ci_se`` = sd / n."""
    pooled = _relative_band(ci_width(df, lo, hi, "_w"), g, n, "_w", "_w", "ci")
    return pooled.withColumn("ci_se", ratio("ci_sd", n))


def pooled_change(
    df: DataFrame,
    g: str,
    n: str = "sample_size",
    it: str = "iter",
    lo: str = "lower_ci",
    hi: str = "upper_ci",
    with_sd: bool = False,
) -> DataFrame:
    """Pooled change in width with a band of "mean / sqrt(n)"."""
    pooled = _relative_band(measure(df, g, n, it, lo, hi), g, n, "dw_ci", "w_ci", "ci_change")
    if not with_sd:
        return pooled.drop("ci_change_sd")
    return pooled.withColumn("ci_se", ratio("ci_change_sd", n))


def clamp(df: DataFrame, cols: str | Sequence[str], cap: float = 2.0) -> DataFrame:
    """Cap columns from above; NULL stays NULL."""
    capped: dict[str, Column] = {c: clamp_above(c, cap) for c in columns(cols)}
    return df.withColumns(capped) if capped else df


def focus(
    df: DataFrame, cols: str | Sequence[str] = (), cap: float = 2.0, above: int = 3, n: str = "sample_size"
) -> DataFrame:
    """The close-up of a curve: capped columns, and only sizes above ``above``."""
    return clamp(df, cols, cap).filter(F.col(n) > above)
