"""Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

``auto`` takes columns with at most SMALL_DISTINCT (estimated) distinct
values from their (value, count) table and refines the others: a small
sample gives a column cut points, one pass counts exactly how many rows lie
at and between them, and so places every target rank at a cut point or in
a gap between two.  A gap of at most ``max_collect`` rows is collected as
(value, count) pairs and walked; a larger one is sampled and counted again.
Only counts of cells travel, so what the driver receives is always bounded,
and a value held by many rows is found by its count.  No round merges
sketches or value maps in one task.

Other methods: ``frequency`` (always the value-count table), ``refine``
(always the refinement), ``distributed`` (value frequencies + bucketed
running counts), ``builtin`` (Spark's exact ``percentile``: its value map
is merged and sorted in one task), ``approx`` (sketch values).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from .order import bucket_of, running_sum

# Columns with at most this many (approximate, rsd 5%) distinct values are
# answered from their (value, count) table: a hash aggregate whose partial
# counts merge across all reducers, so no single task receives one map per
# scan task (as the global built-in ``percentile`` does); only the table,
# bounded by this constant per column, reaches the driver. The rest use the
# sketch-bracket refinement, which collects at most MAX_COLLECT rows.
SMALL_DISTINCT = 20_000


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot numeric ``cols`` to (column, value double), nulls/NaN dropped."""
    if not cols:
        raise ValueError("no columns")
    casted = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    return (casted.unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value")
            .where(F.col("value").isNotNull()))


def quantiles(df: DataFrame, cols: list[str], probs: list[float],
              method: str = "auto", small_distinct: int = SMALL_DISTINCT,
              distinct_estimates: dict | None = None) -> DataFrame:
    """Long table (column, prob, value) of exact quantiles.

    ``method``: ``auto`` picks per column (value-count table up to
    ``small_distinct`` distinct values, sketch-bracket refinement above),
    ``frequency`` forces the value-count table (bounded), ``refine`` the
    refinement, ``builtin`` Spark's global ``percentile``, ``distributed``
    the rank walk; ``approx`` uses ``percentile_approx`` (returns data
    values, not interpolated).
    """
    spark = df.sparkSession
    probs = [float(p) for p in probs]
    if method == "approx":
        row = df.agg(*[F.percentile_approx(nan_to_null(F.col(f"`{c}`").cast("double")), probs, 10000)
                       .alias(c) for c in cols]).collect()[0]
        rows = [(c, p, (row[c] or [None] * len(probs))[i]) for c in cols for i, p in enumerate(probs)]
        return spark.createDataFrame(rows, "column string, prob double, value double")
    small, large = list(cols), []
    if method == "refine":
        return _refine(df, cols, probs)
    if method == "frequency":
        rows = _frequency(df, cols, probs, small_distinct)
        if rows is None:
            raise ValueError(f"more than {small_distinct} distinct values per column")
        return spark.createDataFrame(rows, "column string, prob double, value double")
    if method == "distributed":
        small, large = [], list(cols)
    elif method in ("auto", "hybrid"):
        est = distinct_estimates or \
            df.agg(*[F.approx_count_distinct(f"`{c}`", 0.05).alias(c) for c in cols]).collect()[0].asDict()
        small = [c for c in cols if est[c] <= small_distinct]
        large = [c for c in cols if est[c] > small_distinct]
    parts = []
    if small and method != "builtin":
        rows = _frequency(df, small, probs, small_distinct)
        if rows is None:                       # the estimate was too low: refine those too
            large, small = small + large, []
        else:
            parts.append(spark.createDataFrame(rows, "column string, prob double, value double"))
            small = []
    if small:
        row = df.agg(*[F.percentile(nan_to_null(F.col(f"`{c}`").cast("double")), probs).alias(c)
                       for c in small]).collect()[0]
        rows = [(c, p, (row[c] or [None] * len(probs))[i]) for c in small for i, p in enumerate(probs)]
        parts.append(spark.createDataFrame(rows, "column string, prob double, value double"))
    if large:
        parts.append(_refine(df, large, probs) if method in ("auto", "hybrid") else _rank_walk(df, large, probs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _interpolate(seq: list, n: int, p: float):
    """Linear-interpolated quantile from sorted (value, count) pairs totalling n."""
    if n == 0:
        return None
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    rank, v_lo = 0, None
    for value, cnt in seq:
        if v_lo is None and rank + cnt > lo:
            v_lo = value
        if rank + cnt > hi:
            return v_lo + (value - v_lo) * (pos - lo)
        rank += cnt
    return None


def _frequency(df: DataFrame, cols: list[str], probs: list[float], cap: int):
    """Exact quantiles from the distributed (column, value, count) table.

    Returns rows (column, prob, value), or None when the table holds more
    than ``cap`` (+25% for the estimate's error) rows per column.
    """
    limit = int(cap * 1.25) * len(cols)
    got = (long_values(df, cols).groupBy("column", "value")
           .agg(F.count(F.lit(1)).alias("cnt")).limit(limit + 1).collect())
    if len(got) > limit:
        return None
    per_col: dict = {}
    for r in got:
        per_col.setdefault(r["column"], []).append((r["value"], r["cnt"]))
    rows = []
    for c in cols:
        seq = sorted(per_col.get(c, []))
        n = sum(cnt for _, cnt in seq)
        rows += [(c, p, _interpolate(seq, n, p)) for p in probs]
    return rows


SAMPLE = 2_000             # values sampled from a gap, about
CUTS = 63                  # cut points of a gap at most (they are literals of generated code)
MAX_COLLECT = 20_000


def _refine(df: DataFrame, cols: list[str], probs: list[float], max_collect: int = MAX_COLLECT,
            max_rounds: int = 12) -> DataFrame:
    # several passes read the same narrow projection: keep it (spillable) for
    # the rounds; lost blocks are recomputed from lineage
    # (adding zero makes one value of the two zeros)
    vals = (df.select(*[(nan_to_null(F.col(f"`{c}`").cast("double")) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)])
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return _refine_rounds(df, vals, cols, probs, max_collect, max_rounds)
    finally:
        vals.unpersist()


@dataclass
class _Rank:
    """A rank of a column that is looked for: in the open interval (low, high), which holds ``rows`` rows
    after ``before`` smaller ones, until ``value`` is known."""

    col: int
    rank: int
    rows: int
    before: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def gap(self) -> tuple:
        return self.col, self.low, self.high


def _in_gap(gap: tuple):
    col, low, high = gap
    v = F.col(f"v{col}")
    cond = v.isNotNull()
    if low is not None:
        cond = cond & (v > F.lit(low))
    if high is not None:
        cond = cond & (v < F.lit(high))
    return cond


def _gap_cuts(vals: DataFrame, sizes: dict, turn: int) -> dict:
    """gap -> cut points out of about SAMPLE of its values, all gaps in one pass."""
    gaps = list(sizes)
    picks = F.array(*[F.when(_in_gap(g) & (F.rand(17 * turn + j) < F.lit(min(1.0, SAMPLE / sizes[g]))),
                             F.struct(F.lit(j).alias("j"), F.col(f"v{g[0]}").alias("v"))) for j, g in enumerate(gaps)])
    got = (vals.select(F.explode(F.filter(picks, lambda x: x.isNotNull())).alias("s")).select("s.j", "s.v")
           .limit(4 * SAMPLE * len(gaps)).collect())
    seen: dict = {}
    for r in got:
        seen.setdefault(r["j"], []).append(r["v"])
    found = {}
    for j, values in seen.items():
        values.sort()
        found[gaps[j]] = sorted({values[len(values) * i // (CUTS + 1)] for i in range(1, CUTS + 1)})
    return found


def _cell_counts(vals: DataFrame, cuts: dict) -> dict:
    """gap -> {(cell, at its lower cut point): rows}, exactly, for all gaps in one pass."""
    gaps = list(cuts)
    cells = F.array(*[F.when(_in_gap(g), F.struct(F.lit(j).alias("j"), bucket_of(F.col(f"v{g[0]}"), cuts[g]).alias("cell"),
                                                  F.col(f"v{g[0]}").isin(*[F.lit(x) for x in cuts[g]]).alias("at")))
                      for j, g in enumerate(gaps)])
    got = (vals.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("s"))
           .groupBy("s.j", "s.cell", "s.at").agg(F.count(F.lit(1)).alias("n")).collect())
    found: dict = {g: {} for g in gaps}
    for r in got:
        found[gaps[r["j"]]][r["cell"], r["at"]] = r["n"]
    return found


def _narrow(t: _Rank, cuts: list, cells: dict) -> None:
    """Move a rank to the cut point or the gap in which it lies."""
    before = t.before
    for cell in range(len(cuts) + 1):
        for at in (True, False):
            n = cells.get((cell, at), 0)
            if t.rank >= before + n:
                before += n
                continue
            if at:
                t.value = cuts[cell - 1]
            else:
                t.low = cuts[cell - 1] if cell else t.low
                t.high = cuts[cell] if cell < len(cuts) else t.high
                t.before, t.rows = before, n
            return


def _refine_rounds(df: DataFrame, vals: DataFrame, cols: list[str], probs: list[float], max_collect: int,
                   max_rounds: int) -> DataFrame:
    spark = df.sparkSession
    counts = vals.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))]).collect()[0]
    place = {(i, p): p * (counts[f"n{i}"] - 1) for i in range(len(cols)) for p in probs if counts[f"n{i}"]}
    ranks = {(i, r): _Rank(i, r, counts[f"n{i}"]) for (i, _), pos in place.items() for r in (math.floor(pos), math.ceil(pos))}
    for turn in range(max_rounds):
        wide = [t for t in ranks.values() if t.value is None and t.rows > max_collect]
        if not wide:
            break
        cuts = _gap_cuts(vals, {t.gap: t.rows for t in wide}, turn)
        cells = _cell_counts(vals, cuts)
        for t in wide:
            if t.gap in cuts:
                gap = t.gap
                _narrow(t, cuts[gap], cells[gap])
    # a column with a gap that stayed too wide: exact ranks, nothing collected
    left = sorted({t.col for t in ranks.values() if t.value is None and t.rows > max_collect})
    walked = _rank_walk(df, [cols[i] for i in left], probs) if left else None
    gaps = sorted({t.gap for t in ranks.values() if t.value is None and t.col not in left}, key=repr)
    if gaps:
        # at most max_collect rows a gap
        held = F.array(*[F.when(_in_gap(g), F.struct(F.lit(j).alias("j"), F.col(f"v{g[0]}").alias("v"))) for j, g in enumerate(gaps)])
        got = (vals.select(F.explode(F.filter(held, lambda x: x.isNotNull())).alias("s")).groupBy("s.j", "s.v")
               .agg(F.count(F.lit(1)).alias("n")).collect())
        pairs: dict = {}
        for r in got:
            pairs.setdefault(gaps[r["j"]], []).append((r["v"], r["n"]))
        for t in ranks.values():
            if t.value is None and t.col not in left:
                rank = t.before
                for value, n in sorted(pairs[t.gap]):
                    rank += n
                    if t.rank < rank:
                        t.value = value
                        break
    rows = []
    for i, c in enumerate(cols):
        for p in probs:
            if (i, p) not in place:
                rows.append((c, p, None))
            elif i not in left:
                pos = place[i, p]
                lo, hi = ranks[i, math.floor(pos)].value, ranks[i, math.ceil(pos)].value
                rows.append((c, p, lo + (hi - lo) * (pos - math.floor(pos))))
    found = spark.createDataFrame(rows, "column string, prob double, value double")
    return found.unionByName(walked) if walked is not None else found


def _rank_walk(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    spark = df.sparkSession
    freq = (long_values(df, cols).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))
    walked = running_sum(freq, "cnt", "value", ["column"], out="before", cuts_per_group=True)
    n = freq.groupBy("column").agg(F.sum("cnt").alias("n"))
    targets = (n.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
               .withColumn("pos", F.col("prob") * (F.col("n") - 1))
               .withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
               .withColumn("frac", F.col("pos") - F.col("lo")))
    # targets: (#columns x #probs) rows, bounded by the schema -> broadcast.
    hit = walked.join(F.broadcast(targets), on="column")
    in_lo = (F.col("before") <= F.col("lo")) & (F.col("lo") < F.col("before") + F.col("cnt"))
    in_hi = (F.col("before") <= F.col("hi")) & (F.col("hi") < F.col("before") + F.col("cnt"))
    picked = (hit.where(in_lo | in_hi)
              .groupBy("column", "prob")
              .agg(F.max(F.when(in_lo, F.col("value"))).alias("v_lo"),
                   F.max(F.when(in_hi, F.col("value"))).alias("v_hi"),
                   F.first("frac").alias("frac")))
    return picked.select("column", "prob",
                         (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value"))


def quantile_map(df: DataFrame, cols: list[str], probs: list[float], method: str = "auto",
                 distinct_estimates: dict | None = None) -> dict:
    """{column: {prob: value}} on the driver (bounded: columns x probs)."""
    out: dict = {c: {} for c in cols}
    for r in quantiles(df, cols, probs, method, distinct_estimates=distinct_estimates).collect():
        out[r["column"]][r["prob"]] = r["value"]
    return out
