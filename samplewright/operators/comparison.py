"""Comparison of two groups.

All statistics start from one row per group, so the pairs are joined after aggregation
and the data are shuffled once at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.beta import two_sided_p
from samplewright.functions.normal import density, upper_tail, z_value
from samplewright.functions.nulls import ratio, strict
from samplewright.functions.student import t_quantile
from samplewright.operators.bootstrap import welch_df


def study_subset(df: DataFrame, g: str, names: Sequence[object], k: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``k`` units of the named groups."""
    return df.filter(F.col(g).isin(*names) & F.col(ordinal).between(1, k))


def group_count(df: DataFrame, g: str, name: str = "n") -> DataFrame:
    return df.groupBy(g).agg(F.count(F.lit(1)).alias(name))


def group_summary(df: DataFrame, g: str, v: str) -> DataFrame:
    """``mean, n, sd, se`` of each group."""
    summary = df.groupBy(g).agg(
        strict(F.avg, v).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        strict(F.stddev_samp, v).alias("sd"),
    )
    return summary.withColumn("se", ratio("sd", F.sqrt("n")))


def pair_summaries(
    df: DataFrame, g: str, v: str, pairs: Sequence[tuple[object, object]] | None = None
) -> DataFrame:
    """One row per pair: ``group1, group2, mean1, n1, sd1, mean2, n2, sd2``.

    Without ``pairs`` there must be exactly two groups, a NULL group counting as one (it comes second); anything
    else is an error. So is a listed group without rows. Errors are raised when the result is read.
    """
    summary = group_summary(df, g, v).drop("se")
    row = F.struct(F.col(g).alias("g"), "mean", "n", "sd")
    if pairs is None:
        # Three rows at most are kept of however many groups: enough to tell that there are not two.
        few = summary.orderBy(F.col(g).asc_nulls_last()).limit(3)
        listed = few.agg(F.sort_array(F.collect_list(F.struct(F.col(g).isNull().alias("null"), row.alias("row")))).alias("all"))
        wrong = F.raise_error(F.lit(f"a comparison without pairs needs exactly two groups in {g}"))
        rows = listed.filter(F.when(F.size("all") == 2, F.lit(True)).otherwise(wrong.cast("boolean")))
        rows = rows.select(F.col("all")[0]["row"].alias("a"), F.col("all")[1]["row"].alias("b"))
    else:
        wanted = F.array(*[F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2")) for a, b in pairs])
        pair = df.sparkSession.range(1).select(F.inline(wanted))
        rows = (
            pair.join(summary.select(row.alias("a")), F.col("group1").eqNullSafe(F.col("a.g")), "left")
            .join(summary.select(row.alias("b")), F.col("group2").eqNullSafe(F.col("b.g")), "left")
        )
        missing = F.raise_error(F.concat(F.lit("no rows in "), F.to_json(F.struct("group1", "group2"))))
        found = F.col("a").isNotNull() & F.col("b").isNotNull()
        rows = rows.filter(F.when(found, F.lit(True)).otherwise(missing.cast("boolean")))
    return rows.select(
        F.col("a.g").alias("group1"),
        F.col("b.g").alias("group2"),
        *[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("mean", "n", "sd")],
    )


def welch_test(
    df: DataFrame,
    g: str,
    v: str,
    pairs: Sequence[tuple[object, object]] | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Unequal-variance t test of each pair.

    Gives ``group1, group2, mean1, mean2, t, df, p_value, lower_ci, upper_ci``; the
    interval is that of mean1 - mean2.
    """
    pair = pair_summaries(df, g, v, pairs)
    v1, v2 = F.col("sd1") * F.col("sd1"), F.col("sd2") * F.col("sd2")
    diff = F.col("mean1") - F.col("mean2")
    return (
        pair.withColumn("_se", F.sqrt(ratio(v1, "n1") + ratio(v2, "n2")))
        .withColumn("t", ratio(diff, "_se"))
        .withColumn("df", welch_df(v1, F.col("n1"), v2, F.col("n2")))
        .withColumn("p_value", two_sided_p("t", "df"))
        .withColumn("_error", t_quantile("df", level) * F.col("_se"))
        .withColumn("lower_ci", diff - F.col("_error"))
        .withColumn("upper_ci", diff + F.col("_error"))
        .select("group1", "group2", "mean1", "mean2", "t", "df", "p_value", "lower_ci", "upper_ci")
    )


def pooled_se(
    df: DataFrame, g: str, v: str, pairs: Sequence[tuple[object, object]] | None = None
) -> DataFrame:
    """Pooled sd and standard error of the difference of each pair."""
    pair = pair_summaries(df, g, v, pairs)
    n1, n2, s1, s2 = (F.col(c) for c in ("n1", "n2", "sd1", "sd2"))
    pooled = ratio((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, n1 + n2 - 2)
    return (
        pair.withColumn("s_pooled", F.sqrt(pooled))
        .withColumn("se_diff", F.col("s_pooled") * F.sqrt(ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
        .select("group1", "group2", "n1", "n2", "s_pooled", "se_diff")
    )


def design_analysis(df: DataFrame, effects: Sequence[float], se: str = "se_diff", alpha: float = 0.05) -> DataFrame:
    """Power, Type S and Type M error for every row and plausible effect size.

    Type S is the chance that a significant estimate has the wrong sign, Type M the
    factor by which it overstates the effect on average; both in closed form for a
    normal estimate. The sign of an effect does not matter; zero has no sign to get wrong and is refused.
    """
    if any(e == 0 for e in effects):
        raise ValueError("effects must not be zero")
    z = z_value(1.0 - alpha)
    right, wrong = upper_tail(f"({z!r} - _shift)"), upper_tail(f"({z!r} + _shift)")
    partial = density(f"{z!r} - _shift") + density(f"{z!r} + _shift")
    grid = df.withColumn("possible_effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    return (
        grid.withColumn("_shift", ratio(F.abs("possible_effect"), se))
        .withColumns({"_right": right, "_wrong": wrong})
        .withColumn("power", F.col("_right") + F.col("_wrong"))
        .withColumn("type_s", ratio("_wrong", "power"))
        .withColumn(
            "type_m",
            ratio(F.col("_shift") * (F.col("_right") - F.col("_wrong")) + partial, F.col("_shift") * F.col("power")),
        )
        .select(*df.columns, "possible_effect", "power", "type_s", "type_m")
    )


def two_group_curve(boot2: DataFrame, n_tested: int, n_min: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Per size the mean difference, its interval and width.

    Sizes above ``n_tested``, the number of units really measured, are extrapolated. ``by`` names the columns of a pair
    if there are several.
    """
    cols = ("mean_diff", "lower_ci", "upper_ci", "width_ci")
    return (
        boot2.filter(F.col("sample_size") >= n_min)
        .groupBy(*by, "sample_size")
        .agg(*[strict(F.avg, c).alias(c) for c in cols])
        .withColumn("extrapolated", F.col("sample_size") > n_tested)
    )


def diff_at(boot2: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The difference and its interval at one size, averaged over iterations."""
    cols = ("lower_ci", "upper_ci", "mean_diff")
    return boot2.filter(F.col("sample_size") == n).groupBy(*by).agg(*[strict(F.avg, c).alias(c) for c in cols])
