"""Smooth functions as polynomial columns.

Spark SQL has neither Student's t nor the normal distribution. Both are smooth after
a change of variable, so a Chebyshev interpolant of moderate degree, fitted on the
driver in milliseconds, gives them as plain arithmetic inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.polynomial import chebyshev


def fit_unit_interval(f: Callable[[np.ndarray], np.ndarray], degree: int) -> tuple[float, ...]:
    """Coefficients in ``u = 2x - 1``, lowest power first, of ``f`` on ``0 < x < 1``."""
    k = np.arange(degree + 1)
    nodes = np.cos(np.pi * (k + 0.5) / (degree + 1))
    series = chebyshev.chebfit(nodes, f((nodes + 1) / 2), degree)
    return tuple(float(c) for c in chebyshev.cheb2poly(series))


def polynomial(coefficients: tuple[float, ...], u: str) -> str:
    """Horner form at ``u`` as SQL text; exponents make every literal a DOUBLE.

    Text, because one parsed expression is built far faster than dozens of columns.
    """
    literals = [repr(c) if "e" in repr(c) else f"{c!r}e0" for c in coefficients]
    value = f"({literals[-1]})"
    for c in reversed(literals[:-1]):
        value = f"({value}*{u}+({c}))"
    return value
