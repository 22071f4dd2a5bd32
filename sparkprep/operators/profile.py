"""Profiling and descriptive statistics (one wide aggregate per report)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import HISTOGRAM_BINS
from ..functions.numeric import nan_to_null, skew_label
from ..functions.types import is_floating, numeric_columns
from .clean import duplicate_count, missing_expr
from .quantiles import quantile_map

# Pandas dtype names shown for Spark types.
_DTYPES = {
    T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8",
    T.DoubleType: "float64", T.FloatType: "float32", T.StringType: "object",
    T.BooleanType: "bool", T.TimestampType: "datetime64[ns]", T.TimestampNTZType: "datetime64[ns]",
    T.DateType: "datetime64[ns]",
}


def dtype_name(dt) -> str:
    return _DTYPES.get(type(dt), dt.simpleString())


def _clean(df: DataFrame, c: str):
    return nan_to_null(F.col(f"`{c}`")) if is_floating(df, c) else F.col(f"`{c}`")


def profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row per column: dtype, null count, null %, distinct non-null, sample value.

    Counts and the sample (the smallest value, deterministic) come from one
    aggregate; exact distinct counts from one unpivoted ``(column, value)``
    group-by instead of k ``count(distinct)`` (which would expand every row
    k times).  ``approx_distinct`` uses HyperLogLog++ instead.
    """
    spark = df.sparkSession
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = _clean(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).cast("string").alias(f"s{i}")]
        if approx_distinct:
            aggs.append(F.approx_count_distinct(v).alias(f"d{i}"))
    row = df.agg(*aggs).collect()[0]
    if approx_distinct:
        distinct = {c: row[f"d{i}"] for i, c in enumerate(cols)}
    else:
        distinct = {r["column"]: r["d"] for r in distinct_counts(df).collect()}
    rows = row["__rows"]
    out = []
    for i, c in enumerate(cols):
        nulls = rows - row[f"n{i}"]
        pct = nulls * 100.0 / rows if rows else 0.0
        out.append((c, dtype_name(df.schema[c].dataType), int(nulls), float(pct),
                    int(distinct.get(c, 0)), row[f"s{i}"] if row[f"s{i}"] is not None else "N/A"))
    base = spark.createDataFrame(
        out, "feature string, dtype string, null_count long, null_pct double, "
             "unique_count long, sample_value string")
    return base.withColumn("null_pct", F.round("null_pct", 2))


def distinct_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, d): exact distinct non-null counts via one unpivoted group-by."""
    cols = list(cols or df.columns)
    longv = (df.select(*[_clean(df, c).cast("string").alias(c) for c in cols])
             .unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value").where(F.col("value").isNotNull()))
    return longv.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("d"))


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, duplicate rows."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"), missing_expr(df).alias("missing")).collect()[0]
    dupes = duplicate_count(df).collect()[0]["duplicates"]
    return df.sparkSession.createDataFrame([(seen["rows"], len(df.columns), seen["missing"], dupes)],
                                           "rows long, columns long, missing long, duplicates long")


# Columns per moments aggregate. One wide aggregate over many columns
# generates a method too large for the JVM to compile, so it runs
# interpreted; chunks keep every generated aggregate small.
MOMENT_CHUNK = 4


def moments(df: DataFrame, cols: list[str]) -> dict:
    """{column: (n, mean, std n-1, min, max, g1, g2)}; g1, g2 population form.

    Chunks of MOMENT_CHUNK columns, each one declarative (code-generated)
    aggregate, exploded to one row per column and unioned into one job.
    """
    parts = []
    for start in range(0, len(cols), MOMENT_CHUNK):
        structs = []
        for c in cols[start:start + MOMENT_CHUNK]:
            v = nan_to_null(F.col(f"`{c}`").cast("double"))
            structs.append(F.struct(F.lit(c).alias("feature"), F.count(v).alias("n"),
                                    F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                    F.min(v).alias("lo"), F.max(v).alias("hi"),
                                    F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")))
        parts.append(df.agg(F.array(*structs).alias("m")).select(F.explode("m").alias("m")).select("m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return {r["feature"]: (r["n"], r["mean"], r["std"], r["lo"], r["hi"], r["g1"], r["g2"])
            for r in out.collect()}


def _sample_skew(n: int, std, g1):
    """Bias-corrected skewness G1 = g1 sqrt(n(n-1)) / (n-2); 0 for a constant column."""
    if n < 3:
        return None
    if std == 0 or g1 is None:
        return 0.0
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def _sample_kurt(n: int, std, g2):
    """Bias-corrected excess kurtosis (n-1)/((n-2)(n-3)) ((n+1) g2 + 6); 0 if constant."""
    if n < 4:
        return None
    if std == 0 or g2 is None:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def describe(df: DataFrame, cols=None, digits: int = 4, method: str = "auto") -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max, skewness, kurtosis, label.

    Moments come from chunked one-pass aggregates; quartiles from the exact
    quantile operator. Bias corrections run on the per-column result row.
    """
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else list(cols)
    mom = moments(df, cols)
    q = quantile_map(df, cols, [0.25, 0.5, 0.75], method)
    out = []
    for c in cols:
        n, mean, std, lo, hi, g1, g2 = mom[c]
        out.append((c, float(n), mean, std, lo, q[c].get(0.25), q[c].get(0.5), q[c].get(0.75), hi,
                    _sample_skew(n, std, g1), _sample_kurt(n, std, g2)))
    base = spark.createDataFrame(
        out, "feature string, count double, mean double, std double, min double, p25 double, "
             "p50 double, p75 double, max double, skewness double, kurtosis double")
    num = [c for c in base.columns if c != "feature"]
    return base.select("feature", *[F.round(c, digits).alias(c) for c in num],
                       skew_label(F.col("skewness")).alias("skew_label"))


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS, stage: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the max falls in the last bin."""
    v = nan_to_null(F.col(f"`{col}`").cast("double"))
    bounds = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).collect()[0]
    mn, mx = bounds["mn"], bounds["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    width = (mx - mn) / bins if mx > mn else 0.0
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((v - F.lit(mn)) / F.lit(mx - mn) * bins), F.lit(bins - 1)).cast("int"))
    out = (df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
           .select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                   (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count"))
    return out.withColumn("stage", F.lit(stage)) if stage else out


def box_stats(df: DataFrame, cols=None, method: str = "auto") -> DataFrame:
    """Quartiles, fences, whiskers (extreme values inside the fences), outlier count."""
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else list(cols)
    q = quantile_map(df, cols, [0.25, 0.5, 0.75], method)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = q[c].get(0.25), q[c].get(0.75)
        if q1 is None:
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        v = nan_to_null(F.col(f"`{c}`").cast("double"))
        inside = (v >= lo) & (v <= hi)
        aggs += [F.min(F.when(inside, v)).alias(f"wl{i}"), F.max(F.when(inside, v)).alias(f"wh{i}"),
                 F.count_if(~inside).alias(f"o{i}")]
    row = df.agg(*aggs).collect()[0] if aggs else None
    out = []
    for i, c in enumerate(cols):
        q1, med, q3 = q[c].get(0.25), q[c].get(0.5), q[c].get(0.75)
        if q1 is None:
            continue
        out.append((c, q1, med, q3, q3 - q1, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1),
                    row[f"wl{i}"], row[f"wh{i}"], int(row[f"o{i}"])))
    return spark.createDataFrame(
        out, "feature string, q1 double, median double, q3 double, iqr double, lower_fence double, "
             "upper_fence double, whisker_low double, whisker_high double, outliers long")


def box_outliers(df: DataFrame, col: str, method: str = "auto") -> DataFrame:
    """Rows outside the fences (the points drawn beyond the whiskers)."""
    from .outliers import iqr_fences, iqr_flag
    fence = iqr_fences(df, [col], method)[col]
    return df.where(iqr_flag(col, fence))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent of all rows (nulls in the base) per class, descending."""
    total = df.count()
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    return (counts.select(F.col(target).alias("class"), "count",
                          F.round(F.try_divide(F.col("count") * 100.0, F.lit(total)), 2).alias("pct"))
            .orderBy(F.desc("count"), F.asc("class")))


def train_stats(df: DataFrame, target: str) -> DataFrame:
    """total rows, complete rows, feature count, distinct target values."""
    complete = F.lit(True)
    for c in df.columns:
        m = F.col(f"`{c}`").isNotNull()
        if is_floating(df, c):
            m = m & ~F.isnan(F.col(f"`{c}`"))
        complete = complete & m
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(complete).alias("complete_rows"),
                  F.lit(len(df.columns) - 1).cast("long").alias("features"),
                  F.count_distinct(F.col(target)).alias("target_distinct"))
