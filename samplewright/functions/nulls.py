"""NULL rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(agg: Callable[[Column], Column], c: str | Column) -> Column:
    """The aggregate ``agg(c)``, or NULL as soon as one input row is NULL."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as double, NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clamp_above(c: str | Column, cap: float) -> Column:
    """Cap a value from above. Unlike ``least``, a NULL stays NULL."""
    c = col(c)
    return F.when(c > F.lit(cap), F.lit(cap)).otherwise(c)


def quoted(name: str) -> str:
    """A column name inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def null_safe(*names: str) -> str:
    """SQL text of one struct of key columns: joined by plain equality, NULL equals NULL.

    Unlike ``<=>`` on each column, the struct keeps the hash partitioning that an
    earlier window or aggregate on it set up, so the join needs no second shuffle.
    """
    if not names:
        return "0"
    return "named_struct(" + ", ".join(f"'k{i}', {quoted(c)}" for i, c in enumerate(names)) + ")"
