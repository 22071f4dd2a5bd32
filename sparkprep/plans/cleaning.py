"""Cleaning plans: the automatic fixed-order clean and the configurable one.

Between steps whose outputs are read several times the frame is written
into ``spark.checkpoint.dir``, so a lost executor re-reads files instead of
re-running every upstream shuffle; what a step counts is observed in the
pass that writes it, not scanned for.  The log is a table
``(position, step, target, metric, value)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_SENTINELS, DIRTY_NUMERIC_MIN_RATIO
from ..functions.types import any_numeric_columns, numeric_columns, text_columns
from ..operators import clean, impute, neighbors, outliers
from ..session import materialize, observed


@dataclass
class CleaningLog:
    entries: list = field(default_factory=list)

    def add(self, step: str, target: str, metric: str, value) -> None:
        self.entries.append((len(self.entries), step, target, metric, None if value is None else str(value)))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.entries, "position int, step string, target string, metric string, value string")


def _deduped(df: DataFrame, then=None, **more):
    """Distinct rows written once, and what that one pass counted: rows before and after, and ``more`` of the rows
    after; ``then`` filters them before they are written, and ``kept`` counts what is left."""
    name = "__copies"
    while name in df.columns:
        name = f"_{name}"
    counted, seen = observed(clean.counted_distinct(df, name), before=F.sum(name), after=F.count(F.lit(1)), **more)
    rows, left = observed((then or (lambda d: d))(counted.drop(name)), kept=F.count(F.lit(1)))
    rows = materialize(rows)
    return rows, {**{k: v or 0 for k, v in seen.get.items()}, **left.get}


@dataclass
class AutoClean:
    """dedupe -> classify text -> title-case categoricals -> coerce dirty numerics
    -> sentinel mask -> KNN (numerics) + mode (text) fill -> IQR cap.

    The input is read once: the pass that writes the distinct rows also counts
    them and classifies the text columns, and the pass that writes the coerced
    and masked rows also counts what it masks and what is missing after it.
    """
    key: str
    k_neighbors: int = 5
    sentinels: list | None = None
    min_ratio: float = DIRTY_NUMERIC_MIN_RATIO

    def run(self, df: DataFrame):
        log = CleaningLog()
        codes = list(DEFAULT_SENTINELS if self.sentinels is None else self.sentinels)
        texts = text_columns(df)
        d, seen = _deduped(df, **clean.dirty_exprs(texts))
        log.add("dedupe", "*", "removed", seen["before"] - seen["after"])
        fit = clean.dirty_fit(texts, seen, self.min_ratio)
        cats = fit.categorical
        d = clean.title_case_columns(d, cats)
        log.add("title_case", ",".join(cats), "columns", len(cats))
        d = clean.convert_columns(d, fit.dirty)
        for c in fit.dirty:
            log.add("coerce_numeric", c, "lost_cells", fit.lost(c))
        num = any_numeric_columns(d)
        masking = bool(num and codes)
        d, masked = observed(d, masked=clean.sentinel_expr(num if masking else [], codes))
        if masking:
            d = clean.mask_sentinels(d, num, codes)
        d, gaps = observed(d, missing=clean.missing_expr(d))
        d = materialize(d)
        if masking:
            log.add("sentinel_mask", ",".join(num), "masked", masked.get["masked"])
        else:
            log.add("sentinel_mask", "", "skipped", 0)
        # texts first: their modes are counted on the written rows, not through the neighbour search
        d, fills = impute.mode_fill(d, text_columns(d))
        narrow = numeric_columns(d)
        if narrow:
            d = neighbors.knn_impute(d, self.key, narrow, self.k_neighbors)
        log.add("impute", "*", "missing_before", gaps.get["missing"])
        d = materialize(d)
        d, fences = outliers.cap_all(d, [c for c in any_numeric_columns(d) if c != self.key])
        log.add("iqr_cap", ",".join(fences), "columns", len(fences))
        return d, log


@dataclass
class ManualClean:
    """coerce dirty numerics -> dedupe -> critical drop -> empty guard ->
    knn | ffill | bfill | median -> mode fill (text).

    One pass writes the distinct rows without a gap in a critical column and counts all three.
    """
    key: str
    critical: list = field(default_factory=list)
    method: str = "knn"             # knn | ffill | bfill | median | none
    order_by: str | None = None
    k_neighbors: int = 5
    min_ratio: float = DIRTY_NUMERIC_MIN_RATIO

    def run(self, df: DataFrame):
        log = CleaningLog()
        d, converted = clean.convert_dirty_numerics(df, self.min_ratio)
        log.add("coerce_numeric", ",".join(converted), "columns", len(converted))
        d, seen = _deduped(d, lambda rows: clean.drop_on_critical(rows, self.critical))
        log.add("dedupe", "*", "removed", seen["before"] - seen["after"])
        log.add("critical_drop", ",".join(self.critical), "removed", seen["after"] - seen["kept"])
        if seen["kept"] == 0:
            raise ValueError("no rows left after dropping rows with missing critical values")
        if self.method == "knn":
            d = neighbors.knn_impute(d, self.key, numeric_columns(d), self.k_neighbors)
        elif self.method in ("ffill", "bfill"):
            fn = impute.ffill if self.method == "ffill" else impute.bfill
            d = fn(d, [self.order_by or self.key, self.key] if self.order_by else self.key)
        elif self.method == "median":
            d, _ = impute.median_fill(d, [c for c in numeric_columns(d) if c != self.key])
        log.add("impute", "*", "method", self.method)
        d, _ = impute.mode_fill(d, text_columns(d))
        log.add("mode_fill", ",".join(text_columns(d)), "columns", len(text_columns(d)))
        return d, log


def quality_report(df: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicate rows after cleaning."""
    from ..operators.profile import overview
    return overview(df).select("rows", "missing", "duplicates")
