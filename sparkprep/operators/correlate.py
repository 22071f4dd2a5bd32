"""Pairwise correlations, p-values and grouped OLS lines.

All pairs are computed together (pairwise-complete: each pair only uses
rows where both values are present).  p-values come from the
Student-t distribution evaluated on the tiny per-pair table (bounded by
the number of column pairs, not by rows).
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..functions.types import numeric_columns
from ..session import materialize
from .blocks import slot_batch, summed
from .order import running_sums


# The functions below travel to the Python workers by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns of a tile: the sums of a pair of tiles are six matrices of this width squared.
TILE = 64
# Pairs of tiles whose sums a task holds in one pass over the rows (50 MB).
PASS_TILES = 256


def _pair_stats(df: DataFrame, cols: list[str]) -> list[tuple]:
    """[(i, j, a, b, n, r)] for i < j; r null when n < 3 or a side is constant."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    found = _pearson(df, [F.col(f"`{c}`") for c in cols], pairs)
    return [(i, j, cols[i], cols[j], *stats) for (i, j), stats in zip(pairs, found)]


def _matrix(batch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _column_sums(width: int):
    """Sum and number of the values of every column; NaN is none."""
    def run(batches):
        total = np.zeros((2, width))
        for batch in batches:
            x = _matrix(batch, width)
            total += np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)
        yield slot_batch([0], [total])
    return run


def _tile_sums(width: int, means: np.ndarray, tiles: list):
    """Of each pair of tiles: rows with both values, and sums of x, y, x^2, y^2 and xy over them, around the means."""
    def run(batches):
        total = {slot: np.zeros((6, min(TILE, width - a), min(TILE, width - b))) for slot, a, b in tiles}
        for batch in batches:
            x = _matrix(batch, width) - means
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            here = here.astype(float)
            square = x * x
            for slot, a, b in tiles:
                left, right = slice(a, a + TILE), slice(b, b + TILE)
                for k, (u, v) in enumerate(((here, here), (x, here), (here, x), (square, here), (here, square), (x, x))):
                    total[slot][k] += u[:, left].T @ v[:, right]
        yield slot_batch(list(total), list(total.values()))
    return run


def _pearson(df: DataFrame, columns: list, pairs: list) -> list[tuple]:
    """[(n, r)] of pairs (i, j) of column expressions, each over the rows where both have a value (NaN is none).

    One pass finds the means; one more, for every PASS_TILES pairs of tiles of TILE columns, all sums
    around them, as matrix products in the tasks that meet in Spark.  The number of passes hangs on the
    width of the table alone: two up to about a thousand columns.
    """
    if not pairs:
        return []
    width = len(columns)
    rows = df.select(F.array(*[F.coalesce(nan_to_null(c.cast("double")), F.lit(float("nan"))) for c in columns]).alias("x"))
    sums, counts = summed(rows.mapInArrow(_column_sums(width), "slot long, payload binary"), 2, 1).get(
        0, np.zeros(2 * width)).reshape(2, width)
    means = sums / np.maximum(counts, 1)
    wanted = sorted({(i // TILE * TILE, j // TILE * TILE) for i, j in pairs})
    found: dict = {}
    for at in range(0, len(wanted), PASS_TILES):
        tiles = [(k, a, b) for k, (a, b) in enumerate(wanted[at:at + PASS_TILES])]
        got = summed(rows.mapInArrow(_tile_sums(width, means, tiles), "slot long, payload binary"), 2, len(tiles))
        for k, a, b in tiles:
            shape = 6, min(TILE, width - a), min(TILE, width - b)
            found[a, b] = got[k].reshape(shape) if k in got else np.zeros(shape)
    out = []
    for i, j in pairs:
        n, x, y, xx, yy, xy = found[i // TILE * TILE, j // TILE * TILE][:, i % TILE, j % TILE]
        r = None
        if n >= 3:
            vx, vy = xx - x * x / n, yy - y * y / n
            # deviations below the rounding of the values themselves are none: a constant side
            if vx > 1e-28 * n * means[i] ** 2 and vy > 1e-28 * n * means[j] ** 2:
                r = float((xy - x * y / n) / math.sqrt(vx * vy))
                r = None if math.isnan(r) else max(-1.0, min(1.0, r))
        out.append((int(n), r))
    return out


def t_statistic(r, n):
    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return math.copysign(math.inf, r)
    return r * math.sqrt((n - 2) / (1.0 - r * r))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _cosine_power(lo: float, hi: float, df: float) -> float:
    """Integral of cos(x)**(df - 1) from lo to hi, over panels that widen away from lo."""
    total, a, width = 0.0, lo, 1.0 / math.sqrt(df)
    while a < hi:
        b = min(hi, a + width)
        x = (a + b) / 2 + (b - a) / 2 * _NODES
        part = (b - a) / 2 * float((_WEIGHTS * np.exp((df - 1) / 2 * np.log1p(-np.minimum(np.sin(x) ** 2, 1 - 1e-16)))).sum())
        total += part
        if part < total * 1e-18:
            break
        a, width = b, width * 1.5
    return total


def t_two_sided_p(t, df: float):
    """Two-sided p-value of Student's t with ``df`` degrees of freedom.

    With t = sqrt(df) tan(x) the density is proportional to cos(x)**(df - 1), so the p-value is a
    ratio of two integrals of it, both by Gauss-Legendre panels; exact to rounding for any df.
    """
    if t is None or df is None or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    tail = _cosine_power(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, df)
    return min(1.0, tail / _cosine_power(0.0, math.pi / 2, df))


def correlations(df: DataFrame, cols=None, method: str = "pearson", digits: int | None = 4) -> DataFrame:
    """Long table (col_a, col_b, idx_a, idx_b, n, r, t, p) for every pair i < j."""
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else list(cols)
    if method == "pearson":
        stats = _pair_stats(df, cols)
    elif method == "spearman":
        stats = _spearman_stats(df, cols)
    else:
        raise ValueError(method)
    rows = []
    for i, j, a, b, n, r in stats:
        t = t_statistic(r, n)
        p = t_two_sided_p(t, n - 2) if r is not None else None
        if digits is not None:
            r = None if r is None else round(r, digits)
            p = None if p is None else round(p, digits)
        rows.append((a, b, i, j, n, r, t, p))
    return spark.createDataFrame(
        rows, "col_a string, col_b string, idx_a int, idx_b int, n long, r double, t double, p double")


def significant_pairs(corr: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs i < j whose rounded p-value is below ``alpha``."""
    return corr.where((F.col("idx_a") < F.col("idx_b")) & (F.col("p") < alpha))


def _ranked(df: DataFrame, cols: list[str], gapped: list[str], distinct_limit: int = 100_000) -> DataFrame:
    """Rows of rank arrays r0, r1, ..., one a column: the average ranks of its value among all rows that
    have it, and among those that also have each of the ``gapped`` columns.

    Frequencies are counted once per (column, value) with one counter for each gapped column, and all
    counters run along the values together (distributed, per-column cut points), so every pairwise-complete
    subset is ranked in the same pass.  A column's rank table is broadcast back only when its measured
    size is at most ``distinct_limit``; otherwise it is joined by shuffle.
    """
    values = [nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]
    wide = df.select(*values)
    present = [F.lit(1), *[F.col(f"v{cols.index(c)}").isNotNull().cast("int") for c in gapped]]
    long = (wide.select(*[p.cast("long").alias(f"p{i}") for i, p in enumerate(present)],
                        F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"v{i}").alias("value"))
                                            for i in range(len(cols))])).alias("cell"))
            .select("cell.column", "cell.value", *[f"p{i}" for i in range(len(present))]).where("value IS NOT NULL"))
    counts = [f"n{i}" for i in range(len(present))]
    freq = materialize(long.groupBy("column", "value").agg(*[F.sum(f"p{i}").alias(c) for i, c in enumerate(counts)]))
    run = running_sums(freq, {c: f"before_{c}" for c in counts}, "value", ["column"], cuts_per_group=True)
    ranks = materialize(run.select("column", "value", F.array(*[
        F.col(f"before_{c}") + (F.col(c) + 1) / 2.0 for c in counts]).alias("rank")))      # read once per column
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    # wide tables first, while the rows hold no ranks
    large = [i for i in range(len(cols)) if sizes.get(i, 0) > distinct_limit]
    # rows without a value match nothing, yet a join by shuffle would send them all to one task: they go by all their values
    out = wide.withColumn("__spread", F.xxhash64(*wide.columns)) if large else wide
    for i in [*large, *[i for i in range(len(cols)) if i not in large]]:
        one = ranks.where(F.col("column") == i).select(F.col("value").alias(f"v{i}"), F.col("column").cast("long").alias("__of"),
                                                       F.col("rank").alias(f"r{i}"))
        if i not in large:
            out = out.join(F.broadcast(one.drop("__of")), on=f"v{i}", how="left")
            continue
        # a literal on the side of the ranks would be no key of the join
        of = F.when(F.col(f"v{i}").isNull(), F.col("__spread")).otherwise(F.lit(i))
        out = out.withColumn("__of", of).join(one, on=[f"v{i}", "__of"], how="left").drop("__of")
    return out.select(*[f"r{i}" for i in range(len(cols))])


def _spearman_stats(df: DataFrame, cols: list[str]) -> list[tuple]:
    """Pearson on average ranks; each pair is ranked on its complete rows."""
    cnt = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count(nan_to_null(F.col(f"`{c}`").cast("double"))).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    gapped = [c for i, c in enumerate(cols) if cnt[f"c{i}"] < cnt["n"]]
    pairs = [(i, j, cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return []
    # both passes read the ranks: join once, cut the lineage
    ranked = materialize(_ranked(df, cols, gapped))
    # a column is ranked anew for each partner with gaps
    among = {(i, gapped.index(b) + 1 if b in gapped else 0) for i, j, a, b in pairs} | {
        (j, gapped.index(a) + 1 if a in gapped else 0) for i, j, a, b in pairs}
    place = {key: k for k, key in enumerate(sorted(among))}
    found = _pearson(ranked, [F.col(f"r{i}")[cls] for i, cls in sorted(among)],
                     [(place[i, gapped.index(b) + 1 if b in gapped else 0], place[j, gapped.index(a) + 1 if a in gapped else 0])
                      for i, j, a, b in pairs])
    return [(*pair, *stats) for pair, stats in zip(pairs, found)]


def scatter_bins(df: DataFrame, x: str, y: str, group: str | None = None, bins: int = 50) -> DataFrame:
    """([group], x_bin, y_bin, n): the points of a scatter plot, counted in a grid over the extent of both columns.

    All rows with both values are counted; at most bins * bins cells a group, whatever the number of rows.
    """
    xs, ys = nan_to_null(F.col(f"`{x}`").cast("double")), nan_to_null(F.col(f"`{y}`").cast("double"))
    names = [group] if group else []
    points = df.select(*[F.col(f"`{g}`") for g in names], xs.alias("__x"), ys.alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    low = points.agg(*[f(c).alias(f"{n}{c}") for c in ("__x", "__y") for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def cell(c):
        lo, hi = low[f"lo{c}"], low[f"hi{c}"]
        if lo is None or lo == hi:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")

    return points.groupBy(*names, cell("__x").alias("x_bin"), cell("__y").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def scatter_sample(df: DataFrame, key: str, x: str, y: str, group: str | None = None, size: int = 200, seed: int = 42) -> DataFrame:
    """([group], key, x, y): the ``size`` points of each group whose keys hash lowest.

    The same points on every run and partitioning; each task passes on at most ``size`` rows a group.
    Equal hashes go by key.
    """
    xs, ys = nan_to_null(F.col(f"`{x}`").cast("double")), nan_to_null(F.col(f"`{y}`").cast("double"))
    points = df.select(*([F.col(f"`{group}`").alias("__g")] if group else [F.lit(0).alias("__g")]), F.col(f"`{key}`").alias("__k"),
                       xs.alias("__x"), ys.alias("__y"),
                       F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{seed}"))).alias("__h"))
    order = Window.partitionBy("__g").orderBy("__h", "__k")
    kept = (points.where("__x IS NOT NULL AND __y IS NOT NULL").withColumn("__rn", F.row_number().over(order))
            .where(F.col("__rn") <= size))
    return kept.select(*([F.col("__g").alias(group)] if group else []), F.col("__k").alias(key), F.col("__x").alias(x),
                       F.col("__y").alias(y))


def ols_by_group(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """OLS line per colour group: slope, intercept, r2, n (pairwise complete)."""
    xs, ys = nan_to_null(F.col(x).cast("double")), nan_to_null(F.col(y).cast("double"))
    aggs = [F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
            F.regr_r2(ys, xs).alias("r2"), F.regr_count(ys, xs).alias("n")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)
