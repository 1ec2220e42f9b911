"""Finite-aware and robust numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True where c is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the error-function polynomial 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def quantile(c: str | Column, q: float) -> Column:
    """Exact, linearly interpolated quantile."""
    return F.percentile(c, F.lit(q))
