"""The regularised incomplete beta function as column arithmetic, and the p value of a t test that follows from it.

The continued fraction is folded by ``aggregate`` over its coefficients, as many as its convergence needs, which grows
with the root of the parameters. Everything is SQL text: one parsed expression, evaluated in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions.normal import upper_tail

NORMAL_DF = 1e6  # degrees of freedom beyond which a normal deviate is used
SHIFT = 30  # the series for the gamma functions is used from here on


def _gamma_ratio(a: str) -> str:
    """Gamma(a + 1/2) / Gamma(a): the series of its logarithm at a large argument, carried down to ``a`` by recurrence."""
    z = f"({a} + {SHIFT})"
    series = f"sqrt({z}) * exp(-1e0 / (8 * {z}) + 1e0 / (192 * pow({z}, 3)) - 1e0 / (640 * pow({z}, 5)))"
    return f"(aggregate(sequence(0, {SHIFT - 1}), {series}, (r, j) -> r * ({a} + j) / ({a} + j + 5e-1)))"


def _fraction(p: str, q: str, x: str, steps: str) -> str:
    """The continued fraction of I_x(p, q) by the modified method of Lentz."""
    even = f"(i / 2) * (({q}) - i / 2) * {x} / (({p} + i - 1) * ({p} + i))"
    odd = f"-({p} + (i - 1) / 2) * ({p} + {q} + (i - 1) / 2) * {x} / (({p} + i - 1) * ({p} + i))"
    coefficients = f"transform(sequence(2, {steps}), i -> double(CASE WHEN i % 2 = 0 THEN {even} ELSE {odd} END))"
    first = f"(1e0 / (1e0 - ({p} + {q}) * {x} / ({p} + 1e0)))"
    step = "named_struct('c', 1e0 + k / s.c, 'd', 1e0 / (1e0 + k * s.d), 'h', s.h * (1e0 + k / s.c) / (1e0 + k * s.d))"
    return f"(aggregate({coefficients}, named_struct('c', 1e0, 'd', {first}, 'h', {first}), (s, k) -> {step}).h)"


def two_sided_p(t: str, df: str) -> Column:
    """Two-sided p value of the SQL expressions ``t`` and ``df`` (any real number above 0); small ones keep their digits."""
    a, tt = f"(({df}) / 2e0)", f"(({t}) * ({t}))"
    x, y = f"(({df}) / (({df}) + {tt}))", f"({tt} / (({df}) + {tt}))"
    steps = f"cast(60 + 8 * sqrt({a}) AS INT)"
    front = f"({_gamma_ratio(a)} * exp(-{a} * log1p({tt} / ({df}))) * sqrt({y}) / {math.sqrt(math.pi)!r}e0)"
    near = f"{front} * {_fraction(a, '5e-1', x, steps)} / {a}"
    far = f"1e0 - {front} * {_fraction('5e-1', a, y, steps)} / 5e-1"
    exact = F.expr(f"CASE WHEN {tt} = 0 THEN 1e0 WHEN {x} < ({a} + 1) / ({a} + 25e-1) THEN {near} ELSE {far} END")
    # The equivalent normal deviate of Wallace (1959); its error falls with 1 / df ** 2.
    deviate = f"((8 * ({df}) + 1) / (8 * ({df}) + 3) * sqrt(({df}) * log1p({tt} / ({df}))))"
    return F.when(F.expr(f"({df}) > {NORMAL_DF!r}"), 2 * upper_tail(deviate)).when(F.expr(f"({df}) > 0 AND ({t}) IS NOT NULL"), exact)
