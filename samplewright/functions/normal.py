"""Normal distribution and the Wilson interval."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions.fits import fit_unit_interval, polynomial
from samplewright.functions.nulls import col, ratio


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def _log_scaled_erfc(t: float) -> float:
    """log(erfc(x) / t) + x*x at x = 2 (1/t - 1); asymptotic series in the far tail."""
    x = 2.0 * (1.0 / t - 1.0)
    if x < 20.0:
        return math.log(math.erfc(x) / t) + x * x
    series, term = 1.0, 1.0
    for i in range(1, 8):
        term *= -(2 * i - 1) / (2.0 * x * x)
        series += term
    return math.log(series / (x * math.sqrt(math.pi)) / t)


@lru_cache(maxsize=None)
def _fit() -> tuple[float, ...]:
    return fit_unit_interval(np.vectorize(_log_scaled_erfc, otypes=[float]), 24)


def upper_tail(x: str) -> Column:
    """P(Z > x) of a SQL expression, accurate in relative terms far into the tail."""
    t = f"(1e0/(1e0+abs({x})/{2.0 * math.sqrt(2.0)!r}e0))"
    tail = f"(0.5e0*{t}*exp({polynomial(_fit(), f'(2e0*{t}-1e0)')} - ({x})*({x})/2e0))"
    return F.expr(f"CASE WHEN {x} < 0 THEN 1e0 - {tail} ELSE {tail} END")


def density(x: str) -> Column:
    """Standard normal density of a SQL expression."""
    return F.expr(f"exp(-({x})*({x})/2e0)/{math.sqrt(2.0 * math.pi)!r}e0")


def wilson(successes: str | Column, trials: str | Column, level: float = 0.95) -> Column:
    """Wilson score interval of a proportion as a struct ``point, lower, upper``."""
    z = z_value(level)
    x, n = col(successes).cast("double"), col(trials).cast("double")
    p = ratio(x, n)
    scale = ratio(F.lit(1.0), F.lit(1.0) + ratio(F.lit(z * z), n))
    centre = (p + ratio(F.lit(z * z / 2.0), n)) * scale
    half = F.lit(z) * F.sqrt(ratio(p * (F.lit(1.0) - p), n) + ratio(F.lit(z * z / 4.0), n * n)) * scale
    return F.struct(p.alias("point"), (centre - half).alias("lower"), (centre + half).alias("upper"))
