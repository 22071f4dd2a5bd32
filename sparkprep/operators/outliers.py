"""Outlier fences, flags, capping and dropping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import IQR_FENCE, ZSCORE_THRESHOLD
from ..functions.numeric import clip, nan_to_null
from ..functions.types import any_numeric_columns
from .clean import drop_flagged
from .quantiles import quantile_map


@dataclass
class Fence:
    q1: float | None
    q3: float | None

    @property
    def iqr(self):
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self):
        return None if self.q1 is None else self.q1 - IQR_FENCE * self.iqr

    @property
    def upper(self):
        return None if self.q1 is None else self.q3 + IQR_FENCE * self.iqr


def iqr_fences(df: DataFrame, cols, method: str = "auto") -> dict[str, Fence]:
    """Tukey fences for each column from exact interpolated quartiles (one job set)."""
    q = quantile_map(df, list(cols), [0.25, 0.75], method)
    return {c: Fence(q[c].get(0.25), q[c].get(0.75)) for c in cols}


def iqr_flag(col: str, fence: Fence) -> Column:
    c = nan_to_null(F.col(f"`{col}`"))
    if fence.q1 is None:
        return F.lit(False)
    return F.coalesce((c < F.lit(fence.lower)) | (c > F.lit(fence.upper)), F.lit(False))


def iqr_flags(df: DataFrame, col: str, fence: Fence | None = None, out: str = "is_outlier") -> DataFrame:
    fence = fence or iqr_fences(df, [col])[col]
    return df.withColumn(out, iqr_flag(col, fence))


def zscore_stats(df: DataFrame, cols) -> dict:
    row = df.agg(*[F.avg(nan_to_null(F.col(f"`{c}`"))).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(nan_to_null(F.col(f"`{c}`"))).alias(f"s_{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def zscore_flag(col: str, mean, std, threshold: float = ZSCORE_THRESHOLD) -> Column:
    """|z| > threshold with population std; nulls and zero std never flag."""
    if mean is None or not std:
        return F.lit(False)
    z = F.abs((nan_to_null(F.col(f"`{col}`")) - F.lit(mean)) / F.lit(std))
    return F.coalesce(z > F.lit(threshold), F.lit(False))


def zscore_flags(df: DataFrame, col: str, threshold: float = ZSCORE_THRESHOLD,
                 out: str = "is_outlier") -> DataFrame:
    mean, std = zscore_stats(df, [col])[col]
    return df.withColumn(out, zscore_flag(col, mean, std, threshold))


def cap_columns(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """Clip each fenced column to its fences in one projection.

    A fence is a double, so a capped column is one too, as an integer column would cut it short.
    """
    return df.select(*[
        F.when(F.isnan(f"`{c}`"), F.col(f"`{c}`").cast("double"))      # NaN sorts above every fence, but is no outlier
        .otherwise(clip(F.col(f"`{c}`").cast("double"), fences[c].lower, fences[c].upper)).alias(c)
        if c in fences and fences[c].q1 is not None else F.col(f"`{c}`") for c in df.columns])


def cap_iqr(df: DataFrame, col: str, method: str = "auto") -> DataFrame:
    return cap_columns(df, iqr_fences(df, [col], method))


def cap_all(df: DataFrame, cols=None, method: str = "auto"):
    """Cap every numeric column: one quantile pass for all, one projection."""
    cols = any_numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return df, {}
    fences = iqr_fences(df, cols, method)
    return cap_columns(df, fences), fences


def drop_outliers(df: DataFrame, flag) -> DataFrame:
    return drop_flagged(df, flag)


def outlier_summary(df: DataFrame, flag: str) -> DataFrame:
    """total, outliers, percent (2 dp)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col(flag)).alias("outliers")).select(
        "total", "outliers",
        F.round(F.try_divide(F.col("outliers") * 100.0, F.col("total")), 2).alias("pct"))
