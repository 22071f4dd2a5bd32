"""Numeric expressions: null-safe clip, NaN normalisation, labels, moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SKEW_LABELS, SKEW_MODERATE_BELOW, SKEW_SYMMETRIC_BELOW


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col, lo, hi) -> Column:
    """Clip to [lo, hi]; nulls stay null (unlike least/greatest)."""
    c = _c(col)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c < lo_c, lo_c).when(c > hi_c, hi_c).otherwise(c)


def nan_to_null(col) -> Column:
    """Spark keeps NaN apart from null; the reference does not."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def skew_label(skew) -> Column:
    s = F.abs(_c(skew))
    return (
        F.when(s < SKEW_SYMMETRIC_BELOW, F.lit(SKEW_LABELS[0]))
        .when(s < SKEW_MODERATE_BELOW, F.lit(SKEW_LABELS[1]))
        .when(s.isNotNull(), F.lit(SKEW_LABELS[2]))
    )


def sample_skewness(col) -> Column:
    """Bias-corrected (sample) skewness from Spark's population skewness.

    G1 = g1 * sqrt(n (n-1)) / (n-2); zero for a constant column with n>=3.
    """
    c = _c(col)
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    corrected = g1 * F.sqrt(n * (n - 1)) / (n - 2)          # guarded: n >= 3 below
    return (F.when(n < 3, F.lit(None))
            .when(F.stddev_pop(c) == 0, F.lit(0.0))
            .otherwise(corrected))


def sample_excess_kurtosis(col) -> Column:
    """Bias-corrected excess kurtosis from Spark's population kurtosis.

    G2 = (n-1) / ((n-2)(n-3)) * ((n+1) g2 + 6); zero for a constant column.
    """
    c = _c(col)
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)   # guarded: n >= 4 below
    return (F.when(n < 4, F.lit(None))
            .when(F.stddev_pop(c) == 0, F.lit(0.0))
            .otherwise(corrected))
