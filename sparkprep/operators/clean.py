"""Row and column cleaning operators (dedupe, drops, sentinels, dirty text)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_SENTINELS, DIRTY_NUMERIC_MIN_RATIO
from ..functions.text import coerce_currency_number, title_case
from ..functions.types import any_numeric_columns, is_floating, text_columns


# ---------------------------------------------------------------- duplicates
def drop_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """Full-row (or subset) duplicates removed; one hash-aggregate shuffle."""
    return df.dropDuplicates(list(subset) if subset else None)


def counted_distinct(df: DataFrame, name: str) -> DataFrame:
    """Distinct rows, with how often each occurs as ``name``; the same shuffle as ``drop_duplicates``."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(name))


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """One row: number of rows that repeat an earlier identical row.

    Counted as rows - distinct rows; map-side combine keeps hot rows cheap.
    """
    cols = list(subset) if subset else df.columns
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates"))


# ---------------------------------------------------------------- row filters
def drop_on_critical(df: DataFrame, critical_cols) -> DataFrame:
    """Drop rows null (or NaN) in any critical column; [] keeps all rows."""
    cols = [c for c in (critical_cols or []) if c in df.columns]
    if not cols:
        return df
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"`{c}`").isNotNull()
        if is_floating(df, c):
            cond = cond & ~F.isnan(F.col(f"`{c}`"))
    return df.where(cond)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with no missing cell (``dropna()``)."""
    return drop_on_critical(df, df.columns)


def drop_flagged(df: DataFrame, flag) -> DataFrame:
    """Remove rows whose flag is true (null flags keep the row)."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return df.where(~F.coalesce(f, F.lit(False)))


def require_rows(df: DataFrame, n: int, message: str | None = None) -> DataFrame:
    """Raise when fewer than ``n`` rows; reads at most ``n`` rows."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(message or f"need at least {n} rows, found {have}")
    return df


def missing_expr(df: DataFrame) -> Column:
    """Aggregate: null-or-NaN cells over all columns."""
    total = F.lit(0)
    for c in df.columns:
        m = F.col(f"`{c}`").isNull()
        total = total + F.count_if(m | F.isnan(F.col(f"`{c}`")) if is_floating(df, c) else m)
    return total.cast("long")


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: total null-or-NaN cells over all columns."""
    return df.agg(missing_expr(df).alias("missing"))


# ---------------------------------------------------------------- sentinels
def mask_sentinels(df: DataFrame, cols=None, sentinels=None) -> DataFrame:
    """Exact placeholder codes -> null in numeric columns; ``[]`` turns it off."""
    codes = list(DEFAULT_SENTINELS if sentinels is None else sentinels)
    cols = any_numeric_columns(df) if cols is None else cols
    if not codes or not cols:
        return df
    lits = [F.lit(float(v)) for v in codes]
    return df.select(*[
        F.when(F.col(f"`{c}`").cast("double").isin(*lits), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
        if c in cols else F.col(f"`{c}`") for c in df.columns])


def sentinel_expr(cols, codes) -> Column:
    """Aggregate: cells of ``cols`` that hold a placeholder code."""
    lits = [F.lit(float(v)) for v in codes]
    total = F.lit(0)
    for c in cols:
        total = total + F.count_if(F.col(f"`{c}`").cast("double").isin(*lits))
    return total.cast("long")


def sentinel_count(df: DataFrame, cols=None, sentinels=None) -> DataFrame:
    codes = list(DEFAULT_SENTINELS if sentinels is None else sentinels)
    cols = any_numeric_columns(df) if cols is None else cols
    if not codes or not cols:
        return df.sparkSession.createDataFrame([(0,)], "masked long")
    return df.agg(sentinel_expr(cols, codes).alias("masked"))


# ---------------------------------------------------------------- dirty numerics
@dataclass
class DirtyNumericFit:
    """Which text columns parse as numbers often enough to convert."""
    rows: int
    threshold: float
    parsed: dict = field(default_factory=dict)      # column -> parsed cells
    non_null: dict = field(default_factory=dict)    # column -> non-null cells

    @property
    def dirty(self) -> list[str]:
        return [c for c, n in self.parsed.items() if n >= self.threshold]

    @property
    def categorical(self) -> list[str]:
        return [c for c, n in self.parsed.items() if n < self.threshold]

    def lost(self, col: str) -> int:
        """Non-null cells that become null by the conversion."""
        return self.non_null[col] - self.parsed[col]


def dirty_exprs(cols) -> dict[str, Column]:
    """Aggregates of ``classify_dirty_numerics``: rows, and parsed and present cells of each column."""
    aggs = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(cols):
        aggs[f"p{i}"] = F.count(coerce_currency_number(F.col(f"`{c}`")))
        aggs[f"n{i}"] = F.count(F.col(f"`{c}`"))
    return aggs


def dirty_fit(cols, found: dict, min_ratio: float = DIRTY_NUMERIC_MIN_RATIO) -> DirtyNumericFit:
    """The classification that follows from the values of ``dirty_exprs``."""
    rows = found["rows"] or 0
    return DirtyNumericFit(rows, max(1.0, rows * min_ratio), {c: found[f"p{i}"] for i, c in enumerate(cols)},
                           {c: found[f"n{i}"] for i, c in enumerate(cols)})


def classify_dirty_numerics(df: DataFrame, min_ratio: float = DIRTY_NUMERIC_MIN_RATIO,
                            cols=None) -> DirtyNumericFit:
    """One aggregate over all text columns: parsed cells vs ``max(1, ratio*rows)``."""
    cols = text_columns(df) if cols is None else cols
    row = df.agg(*[expr.alias(name) for name, expr in dirty_exprs(cols).items()]).collect()[0]
    return dirty_fit(cols, row.asDict(), min_ratio)


def convert_columns(df: DataFrame, cols) -> DataFrame:
    """Currency-strip and coerce the given text columns to double."""
    cols = set(cols)
    return df.select(*[coerce_currency_number(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def convert_dirty_numerics(df: DataFrame, min_ratio: float = DIRTY_NUMERIC_MIN_RATIO):
    """(converted frame, converted column list)."""
    fit = classify_dirty_numerics(df, min_ratio)
    return convert_columns(df, fit.dirty), fit.dirty


def title_case_columns(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[title_case(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])
