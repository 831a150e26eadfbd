"""Numeric expressions: bias-corrected moments and null-aware correlation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness (G1); null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    return (F.when(n < 3, None)
            .when(F.min(c) == F.max(c), F.lit(0.0))
            .otherwise(F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); null below four values, 0 for a constant."""
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return (F.when(n < 4, None)
            .when(F.min(c) == F.max(c), F.lit(0.0))
            .otherwise(factor * ((n + 1) * F.kurtosis(c) + 6)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; null if one is constant.

    ``corr`` raises on a constant column in ANSI mode, so this divides the centred sums of
    the shared rows with ``try_divide``.
    """
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    r = F.try_divide(F.regr_sxy(a, b), spread)
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if high is not None:
        c = F.least(F.lit(float(high)), c)
    if low is not None:
        c = F.greatest(F.lit(float(low)), c)
    return c
