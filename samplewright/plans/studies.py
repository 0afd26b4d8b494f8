"""The studies a user runs: each is a few operators in a row.

Those that read their resamples or the change in width more than once store them first, in the folder shared by the
session, so that they are drawn once. The other studies stay lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.operators import comparison, coverage, precision, survey
from samplewright.operators.bootstrap import (
    ITERS,
    N_MAX,
    N_MIN,
    REFERENCE_SIZE,
    SEED,
    bootstrap_pairs, bootstrap_two,
    bootstrap_with_median,
    t_ci,
)
from samplewright.operators.ordering import shuffle_rank
from samplewright.operators.reshape import clean_names, coerce_numeric, exclude_groups, wide_to_long
from samplewright.sources.files import stage


def clean_measurements(
    raw: DataFrame,
    first: str,
    last: str,
    drop: Sequence[str] = (),
    id: str = "rep",
    max_rep: int = REFERENCE_SIZE,
    names_to: str = "group",
    values_to: str = "value",
    seed: int = SEED,
) -> DataFrame:
    """Wide laboratory table to ``group, ordinal, value``, randomly ordered in each group.

    ``first`` and ``last`` are cleaned names and bound the columns coerced to numbers.
    """
    numeric = coerce_numeric(clean_names(raw), first, last).drop(*drop)
    long = wide_to_long(numeric, id, names_to, values_to, max_rep)
    return shuffle_rank(long, names_to, id, seed).select(names_to, "ordinal", values_to)


def resample_with_ci(
    df: DataFrame,
    g: str,
    v: str,
    unit: str | Sequence[str],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    at_n: int = REFERENCE_SIZE,
    seed: int = SEED,
    rng: str = "xxhash64",
    level: float = 0.95,
    exclude: Sequence[object] = (),
) -> DataFrame:
    """Resamples of every group with population median and t interval.

    Excluded groups are left out before resampling; draws of the others do not depend
    on them.
    """
    kept = exclude_groups(df, g, exclude) if exclude else df
    boot = bootstrap_with_median(kept, g, v, unit, n_min, n_max, iters, at_n, seed, rng)
    return t_ci(boot, level=level)


def coverage_by_group(boot_ci: DataFrame, g: str, level: float = 0.95, boundary: str = "null") -> DataFrame:
    """Coverage of each group and size, with its Wilson interval."""
    return coverage.coverage_ci(coverage.coverage(boot_ci, g, boundary=boundary), g, level=level)


def coverage_curve(boot_ci: DataFrame, g: str, level: float = 0.95, boundary: str = "null") -> DataFrame:
    """Coverage per size, averaged over groups."""
    return coverage.pooled_curve(coverage_by_group(boot_ci, g, level, boundary))


def precision_tables(boot_ci: DataFrame, g: str, cap: float = 2.0) -> dict[str, DataFrame]:
    """The width and change-in-width tables of a study; the measured widths are stored once."""
    measured = stage(precision.measure(boot_ci, g))
    width = precision.pooled_width_rel(boot_ci, g)
    change = precision.pooled_change(measured, g, with_sd=True)
    return {
        "by_group": precision.precision_by_group(measured, g),
        "width_se": precision.pooled_width_se(boot_ci, g),
        "width": width,
        "width_focus": precision.focus(width),
        "change": change,
        "change_focus": precision.focus(change, ["ci_change_mean", "upper_se"], cap),
    }


def two_group_tables(
    df: DataFrame,
    g: str,
    group1: object,
    group2: object,
    v: str,
    unit: str,
    n_tested: int,
    effects: Sequence[float],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    seed: int = SEED,
    rng: str = "xxhash64",
    store: bool = True,
) -> dict[str, DataFrame]:
    """Everything reported on two groups of which ``n_tested`` units each were measured.

    ``unit`` is the ordinal of a unit in its group; units above ``n_tested`` are unused. The
    resamples are stored once unless ``store`` is False.
    """
    tested = comparison.study_subset(df, g, [group1, group2], n_tested, unit)
    boot = bootstrap_two(tested, g, group1, group2, v, unit, n_min, n_max, iters, seed, rng)
    boot = stage(boot) if store else boot
    pair = [(group1, group2)]
    pooled = comparison.pooled_se(tested, g, v, pair)
    return {
        "counts": comparison.group_count(tested, g),
        "summary": comparison.group_summary(tested, g, v),
        "welch": comparison.welch_test(tested, g, v, pair),
        "boot": boot,
        "curve": comparison.two_group_curve(boot, n_tested, n_min),
        "diff": comparison.diff_at(boot, n_tested),
        "pooled_se": pooled,
        "design": comparison.design_analysis(pooled, effects),
    }


def pair_tables(
    df: DataFrame,
    g: str,
    pairs: Sequence[tuple[object, object]],
    v: str,
    unit: str,
    n_tested: int,
    effects: Sequence[float],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    seed: int = SEED,
    rng: str = "xxhash64",
    store: bool = True,
) -> dict[str, DataFrame]:
    """:func:`two_group_tables` of many pairs at once: every table has a row per pair where that one has a single row.

    A group is resampled once for all its pairs.
    """
    names = list(dict.fromkeys(x for p in pairs for x in p))
    tested = comparison.study_subset(df, g, names, n_tested, unit)
    boot = bootstrap_pairs(tested, g, pairs, v, unit, n_min, n_max, iters, seed, rng)
    boot = stage(boot) if store else boot
    pooled = comparison.pooled_se(tested, g, v, pairs)
    pair = ["group1", "group2"]
    return {
        "counts": comparison.group_count(tested, g),
        "summary": comparison.group_summary(tested, g, v),
        "welch": comparison.welch_test(tested, g, v, pairs),
        "boot": boot,
        "curve": comparison.two_group_curve(boot, n_tested, n_min, pair),
        "diff": comparison.diff_at(boot, n_tested, pair),
        "pooled_se": pooled,
        "design": comparison.design_analysis(pooled, effects),
    }


def survey_tables(
    df: DataFrame,
    class_col: str,
    keep: str,
    metrics: dict[str, tuple[str, str]],
    n: str = "n",
    common: Sequence[str] = (),
    thresholds: Sequence[float] = (30, 100),
) -> dict[str, dict[str, DataFrame]]:
    """Sample-size tables of each metric of a literature survey.

    ``metrics`` maps a label to (metric column, value column); records of a label are
    those whose metric column holds the label.
    """
    tables = {}
    for label, (metric_col, value_col) in metrics.items():
        part = survey.split_by_metric(df, class_col, keep, metric_col, label, [*common, n, value_col, metric_col])
        tables[label] = {
            "records": part,
            "known": survey.known_count(part, n),
            "distribution": survey.distribution_summary(part, n),
            "shares": survey.share_above(part.filter(F.col(n).isNotNull()), n, thresholds),
            "histogram": survey.histogram(part, n),
        }
    return tables
