"""Imputation: mode, median, constant, forward/backward fill, temporal detection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TEMPORAL_MIN_RATIO, UNKNOWN_CATEGORY
from ..functions.numeric import nan_to_null
from ..functions.types import numeric_columns, text_columns
from .order import fill_ordered
from .quantiles import quantile_map


def modes(df: DataFrame, cols) -> DataFrame:
    """(column, mode): most frequent non-null value, smallest on ties.

    Unpivot -> count per (column, value) with map-side combine -> per
    column ``min(struct(-count, value))``, again a partial aggregate; no
    column's distinct values are ever held by one task.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, mode string")
    longv = (df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
             .unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value").where(F.col("value").isNotNull()))
    counts = longv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("k"), "value")).alias("b"))
    return best.select("column", F.col("b.value").alias("mode"))


def mode_fill(df: DataFrame, cols=None, fallback: str = UNKNOWN_CATEGORY):
    """Fill text columns with their mode (``fallback`` when all null). Returns (df, fills)."""
    cols = text_columns(df) if cols is None else list(cols)
    found = {r["column"]: r["mode"] for r in modes(df, cols).collect()}   # <= #columns rows
    fills = {c: found.get(c, fallback) for c in cols}
    return fill_constants(df, fills), fills


def fill_constants(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[
        F.coalesce(nan_to_null(F.col(f"`{c}`")) if _floating(df, c) else F.col(f"`{c}`"),
                   F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
        if c in fills and fills[c] is not None else F.col(f"`{c}`") for c in df.columns])


def _floating(df: DataFrame, c: str) -> bool:
    from ..functions.types import is_floating
    return is_floating(df, c)


def median_fill(df: DataFrame, cols=None, method: str = "auto"):
    """Fill numeric columns with their exact median. Returns (df, fills)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return df, {}
    med = quantile_map(df, cols, [0.5], method)
    fills = {c: med[c].get(0.5) for c in cols}
    # A numeric column with gaps is floating in the reference, so a median
    # such as 25.5 is kept rather than truncated into an integer column.
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in fills else F.col(f"`{c}`") for c in df.columns])
    return fill_constants(df, fills), fills


def ffill(df: DataFrame, order_by, partition_by=(), cols=None, buckets=None) -> DataFrame:
    """Forward fill every column (default) along ``order_by``."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    cols = [c for c in (cols or df.columns) if c not in keys + groups]
    return fill_ordered(df, cols, keys, groups, "forward", buckets)


def bfill(df: DataFrame, order_by, partition_by=(), cols=None, buckets=None) -> DataFrame:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    cols = [c for c in (cols or df.columns) if c not in keys + groups]
    return fill_ordered(df, cols, keys, groups, "backward", buckets)


# Date formats tried by the temporal detector, as (Spark
# pattern, strptime twin).  Each has a separator, so bare numbers never
# look like dates.
DATE_FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("MM-dd-yyyy", "%m-%d-%Y"),
    ("yyyy.MM.dd", "%Y.%m.%d"),
    ("dd.MM.yyyy", "%d.%m.%Y"),
    ("dd MMM yyyy", "%d %b %Y"),
    ("MMM dd, yyyy", "%b %d, %Y"),
]


_DIGIT_FIELDS = set("yudDHhKkmsSMLQq")


def _shape(fmt: str) -> str:
    """A pattern that every text of the date format ``fmt`` matches: a run of one letter is a field of
    digits (letters for months and the like), the rest stands for itself."""
    if "[" in fmt:                       # optional parts: any text may fit
        return ""
    out = []
    for quoted, field, letter, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z'])", fmt):
        if not field:
            out.append(re.escape(quoted or other))
        elif letter not in _DIGIT_FIELDS or (letter in "MLQq" and len(field) > 2):
            out.append(".+")
        else:
            out.append(r"[+-]?\d+")
    return "^" + "".join(out) + "$"


def temporal_scores(df: DataFrame, cols=None, formats=None) -> DataFrame:
    """(column, sampled, best_ratio, best_format) for text columns.

    Each column is judged on all its non-null values; the best single
    format is the one that parses most of them, as pandas infers one format.
    Equal values are parsed once, and only in formats whose shape they have,
    as a failing parse costs far more than a pattern.
    """
    spark = df.sparkSession
    formats = [f[0] for f in DATE_FORMATS] if formats is None else list(formats)
    cols = text_columns(df) if cols is None else list(cols)
    if not cols:
        return spark.createDataFrame([], "column string, sampled long, best_ratio double, best_format string")
    longv = df.select(*[F.col(f"`{c}`") for c in cols]).unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value").where(F.col("value").isNotNull())
    counted = longv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    parsed = counted.select("column", "n", *[
        F.when(F.col("value").rlike(_shape(fmt)) & F.try_to_timestamp(F.when(F.col("value").rlike(_shape(fmt)), F.col("value")),
                                                                      F.lit(fmt)).isNotNull(), F.col("n")).otherwise(0).alias(f"f{i}")
        for i, fmt in enumerate(formats)])
    agg = parsed.groupBy("column").agg(F.sum("n").alias("sampled"),
                                       *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(formats))])
    best = F.greatest(*[F.col(f"f{i}") for i in range(len(formats))])
    fmt_pick = F.coalesce(*[F.when(F.col(f"f{i}") == best, F.lit(fmt)) for i, fmt in enumerate(formats)])
    return agg.select("column", "sampled", (best / F.col("sampled")).alias("best_ratio"),
                      F.when(best > 0, fmt_pick).alias("best_format"))


def detect_temporal(df: DataFrame, cols=None, min_ratio: float = TEMPORAL_MIN_RATIO) -> list[str]:
    scores = temporal_scores(df, cols).collect()
    return sorted(r["column"] for r in scores if r["sampled"] and r["best_ratio"] >= min_ratio)
