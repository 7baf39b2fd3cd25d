"""Null-safe numeric helpers: an unknown input gives an unknown result, never a low one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that densities refer to.
DENSITY_LINES = 500.0


def number(c: Column) -> Column:
    """A double, null where the value is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def positive(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def saturate(c: Column, scale: float) -> Column:
    return clamp(c / scale)


def offset(c: Column, free: float, scale: float) -> Column:
    """Only what exceeds `free` counts."""
    return saturate(positive(c - free), scale)


def density(c: Column, lines: Column, scale: float) -> Column:
    """Occurrences for DENSITY_LINES lines."""
    return F.when(lines.isNotNull(), saturate(positive(c) * DENSITY_LINES / F.greatest(F.lit(1.0), lines), scale))


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b rounded; 0.0 where b is zero or unknown."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def percent(score: Column) -> Column:
    """A score as a percentage, unknown ones as 0."""
    return F.round(clamp(F.coalesce(score, F.lit(0.0))) * 100, 2)


def coverage_of(parts: list[tuple[float, Column]]) -> Column:
    """The weight of the parts that are known."""
    return sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))


def total_of(parts: list[tuple[float, Column]]) -> Column:
    return sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for w, c in parts), F.lit(0.0))


def mean_of(total: Column, coverage: Column) -> Column:
    """Weighted mean of the known parts, null where none is known."""
    return F.when(coverage > 0, clamp(F.when(F.abs(coverage - 1.0) <= 1e-9, total).otherwise(F.try_divide(total, coverage))))
