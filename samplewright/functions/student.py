"""Student's t distribution."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions.beta import NORMAL_DF
from samplewright.functions.fits import fit_unit_interval, polynomial

FIT_DEGREE = 24  # relative error below 1e-13 for every df >= 1
TABLE_DF = 200  # whole degrees of freedom looked up instead of fitted


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log gamma(a + 1/2) - log gamma(a), without cancellation for large ``a``."""
    exact = np.array([math.lgamma(v + 0.5) - math.lgamma(v) if v < 30.0 else 0.0 for v in a.ravel()])
    big = np.maximum(a, 30.0)
    series = 0.5 * np.log(big) - 1 / (8 * big) + 1 / (192 * big**3) - 1 / (640 * big**5)
    return np.where(a < 30.0, exact.reshape(a.shape), series)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in z.ravel()]).reshape(z.shape)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d)
        c = 1.0 + even / c
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d)
        c = 1.0 + odd / c
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def upper_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0, any real df > 0; vectorised."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    large = df > NORMAL_DF
    a, b = np.where(large, 1.0, df) / 2.0, np.full_like(df, 0.5)
    log_term = np.log1p(t * t / df)
    x, y = df / (df + t * t), t * t / (df + t * t)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) - a * log_term + b * np.log(y))
        direct = (x < (a + 1.0) / (a + b + 2.0)) & ~large
        other = ~direct & ~large
        left = front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a
        right = 1.0 - front * _beta_fraction(b, a, np.where(other, y, 0.0)) / b
    exact = 0.5 * np.where(t == 0.0, 1.0, np.where(direct, left, right))
    # The equivalent normal deviate of Wallace (1959); its error falls with 1/df^2.
    deviate = (8.0 * df + 1.0) / (8.0 * df + 3.0) * np.sqrt(df * log_term)
    return np.where(large, _normal_tail(deviate), exact)


def quantile(level: float, df: np.ndarray) -> np.ndarray:
    """Two-sided t quantile by bisection; runs on the driver for a handful of df."""
    df = np.asarray(df, float)
    tail = (1.0 - level) / 2.0
    low, high = np.zeros_like(df), np.full_like(df, 1.0 / tail)
    for _ in range(100):
        middle = (low + high) / 2.0
        above = upper_tail(middle, df) > tail
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2.0


@lru_cache(maxsize=None)
def _fit(level: float) -> tuple[float, ...]:
    # log t is smooth in x = 1/df over the whole range 1 <= df < infinity.
    return fit_unit_interval(lambda x: np.log(quantile(level, 1.0 / x)), FIT_DEGREE)


def t_quantile_sql(df: str, level: float = 0.95) -> str:
    """SQL text of the two-sided t quantile for integer or fractional ``df`` >= 1."""
    return f"exp({polynomial(_fit(level), f'(2e0/({df})-1e0)')})"


def t_quantile(df: str, level: float = 0.95) -> Column:
    """Two-sided t quantile of the SQL expression ``df``; NULL below one."""
    return F.expr(f"CASE WHEN {df} >= 1 THEN {t_quantile_sql(df, level)} END")


@lru_cache(maxsize=None)
def _table(level: float) -> str:
    values = quantile(level, np.arange(1, TABLE_DF + 1))
    return "array(" + ", ".join(f"{float(t)!r}e0" for t in values) + ")"


def t_quantile_whole(df: str, level: float = 0.95) -> Column:
    """The same for whole ``df``: a constant array, and the fit beyond it."""
    return F.expr(
        f"CASE WHEN {df} > {TABLE_DF} THEN {t_quantile_sql(df, level)} "
        f"WHEN {df} >= 1 THEN get({_table(level)}, cast({df} - 1 AS INT)) END"
    )
