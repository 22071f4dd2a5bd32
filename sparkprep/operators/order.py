"""Order-dependent operators without a single-partition window.

``Window.orderBy`` with no partition key plans ``Exchange SinglePartition``:
every row goes through one task.  Here the order key is cut at fixed
approximate quantiles into buckets; each bucket is windowed on its own and
a tiny per-bucket carry (one row per bucket, or per group and bucket) is
prefix-combined and joined back.  A hot group is therefore split over many
buckets as well.  Cut points are computed once and embedded as literals, so
a recomputed task sees the same buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null
from ..functions.types import is_floating
from ..session import shuffle_partitions

_B = "__bucket"


def default_buckets(df: DataFrame) -> int:
    """Two for each shuffle partition, so a bucket shrinks as the cluster's setting grows."""
    return max(8, 2 * shuffle_partitions(df.sparkSession))


def cut_points(df: DataFrame, col: str, buckets: int, per_bucket: int = 100) -> list:
    """Sorted distinct cut points of ``col`` (any ordered type), from a sampled ``per_bucket`` rows a bucket.

    Only the evenness of the buckets hangs on the sample, never a result.  No sketch is merged:
    the driver receives the sample, at most 4 * buckets * per_bucket values.
    """
    if buckets <= 1:
        return []
    value = nan_to_null(F.col(f"`{col}`")) if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{col}`")
    known = df.select(value.alias("v")).where("v IS NOT NULL")
    wanted = buckets * per_bucket
    share = min(1.0, wanted / max(1, known.count()))
    some = known if share == 1.0 else known.sample(fraction=share, seed=42)
    values = sorted(r["v"] for r in some.limit(4 * wanted).collect())
    return sorted({values[len(values) * i // buckets] for i in range(1, buckets)}) if values else []


def bucket_of(col: Column, cuts: list) -> Column:
    """Number of cut points <= value; nulls -> -1.

    Few cuts are a balanced CASE tree.  Many are looked up in two steps, first the block of
    cuts, then the place in it, so the work for a row grows with the root of their number.
    """

    def search(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(cuts) <= 256:
        return F.when(col.isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i:i + size] for i in range(0, len(cuts), size)]
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda x: x <= col))
    inside = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), block)
    place = F.size(F.filter(inside, lambda x: x <= col))
    return (F.when(col.isNull(), F.lit(-1)).when(col < F.lit(cuts[0]), F.lit(0))
            .otherwise((block - 1) * F.lit(size) + place))


def _order(cols: list[str], ascending: bool) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() if ascending else F.col(f"`{c}`").desc_nulls_last() for c in cols]


def fill_ordered(df: DataFrame, cols: list[str], order_by, partition_by=(),
                 direction: str = "forward", buckets: int | None = None) -> DataFrame:
    """Forward (last seen) or backward (next seen) fill of ``cols``.

    ``order_by`` should be a total order (add a key column to break ties);
    leading gaps (trailing for backward) stay null, as in the reference.
    """
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if not cols:
        return df
    asc = direction in ("forward", "ffill")
    nb = buckets or default_buckets(df)
    cuts = cut_points(df, order_cols[0], nb)
    # NaN is a missing value, as everywhere in this library
    data = df.select(*[nan_to_null(F.col(f"`{c}`")).alias(c) if is_floating(df, c) else F.col(f"`{c}`") for c in df.columns])
    data = data.withColumn(_B, bucket_of(F.col(f"`{order_cols[0]}`"), cuts))
    keys = groups + [_B]
    w = (Window.partitionBy(*keys).orderBy(*_order(order_cols, asc))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = data.select(*[F.col(f"`{c}`") for c in data.columns if c not in cols],
                        *[F.last(f"`{c}`", ignorenulls=True).over(w).alias(c) for c in cols])
    # Per bucket: its last non-null value in fill direction, from a partial
    # aggregate over the raw rows (no window, no full shuffle).
    pos = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    pick = F.max_by if asc else F.min_by
    per_bucket = data.groupBy(*keys).agg(
        *[pick(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), pos)).alias(c) for c in cols])
    if groups:
        cw = (Window.partitionBy(*groups).orderBy(F.col(_B).asc() if asc else F.col(_B).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
        carry = per_bucket.select(*[F.col(g).alias(f"__of_{i}") for i, g in enumerate(keys)],
                                  *[F.last(f"`{c}`", ignorenulls=True).over(cw).alias(f"__carry_{c}") for c in cols])
        same = F.lit(True)                    # a null group key is a group of its own
        for i, g in enumerate(keys):
            same = same & local[g].eqNullSafe(F.col(f"__of_{i}"))
        joined = local.join(carry, same, "left")
    else:
        # at most buckets+1 rows: prefix-combined on the driver, broadcast back
        rows = sorted(per_bucket.collect(), key=lambda r: r[_B], reverse=not asc)
        seen = {c: None for c in cols}
        carried = []
        for r in rows:
            carried.append((r[_B], *[seen[c] for c in cols]))
            for c in cols:
                if r[c] is not None:
                    seen[c] = r[c]
        schema = T.StructType([T.StructField(_B, T.IntegerType())] +
                              [T.StructField(f"__carry_{c}", df.schema[c].dataType) for c in cols])
        carry = df.sparkSession.createDataFrame(carried, schema)
        joined = local.join(F.broadcast(carry), on=keys, how="left")
    return joined.select(*[
        F.coalesce(F.col(f"`{c}`"), F.col(f"`__carry_{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
        for c in df.columns
    ])


def running_sum(df: DataFrame, value: str, order_by: str, partition_by=(), out: str = "before",
                inclusive: bool = False, buckets: int | None = None,
                cuts_per_group: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows (by ``order_by``) of the group.

    ``order_by`` must be unique within a group (e.g. distinct values with
    their counts).  With ``cuts_per_group`` each group gets its own cut
    points; the groups must then be few (e.g. one per column of a table),
    since their cut arrays and carries are broadcast.
    """
    return running_sums(df, {value: out}, order_by, partition_by, inclusive, buckets, cuts_per_group)


def running_sums(df: DataFrame, values: dict, order_by: str, partition_by=(), inclusive: bool = False,
                 buckets: int | None = None, cuts_per_group: bool = False) -> DataFrame:
    """``running_sum`` of several columns at once, as value -> name of its sum, over one shuffle and one carry."""
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    nb = buckets or default_buckets(df)
    if cuts_per_group and groups:
        # each group's cuts come from its share of a bounded sample, as in cut_points
        total = max(1, df.count())
        wanted = 100 * nb
        some = df.select(*groups, order_by) if total <= wanted else df.select(*groups, order_by).sample(wanted / total, seed=42)
        seen: dict = {}
        for r in some.where(F.col(order_by).isNotNull()).limit(4 * wanted).collect():
            seen.setdefault(tuple(r[g] for g in groups), []).append(r[order_by])
        rows = [(*g, sorted({sorted(v)[len(v) * i // nb] for i in range(1, nb)})) for g, v in seen.items()]
        cuts = df.sparkSession.createDataFrame(rows, T.StructType(
            [df.schema[g] for g in groups] + [T.StructField("__cuts", T.ArrayType(df.schema[order_by].dataType))]))
        data = (df.join(F.broadcast(cuts), on=groups, how="left")
                .withColumn("__cuts", F.coalesce("__cuts", F.array()))
                .withColumn(_B, F.size(F.filter("__cuts", lambda x: x <= F.col(order_by))))
                .drop("__cuts"))
    else:
        data = df.withColumn(_B, bucket_of(F.col(order_by), cut_points(df, order_by, nb)))
    keys = groups + [_B]
    names = list(values)
    w = (Window.partitionBy(*keys).orderBy(F.col(order_by).asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = data.withColumns({f"__run{i}": F.sum(v).over(w) for i, v in enumerate(names)})
    totals = data.groupBy(*keys).agg(*[F.sum(v).alias(f"__tot{i}") for i, v in enumerate(names)])      # partial aggregate
    carried = [f"__carry{i}" for i in range(len(names))]
    if groups and not cuts_per_group:
        cw = (Window.partitionBy(*groups).orderBy(F.col(_B).asc())
              .rowsBetween(Window.unboundedPreceding, -1))
        carry = totals.select(*keys, *[F.coalesce(F.sum(f"__tot{i}").over(cw), F.lit(0)).alias(c) for i, c in enumerate(carried)])
        joined = local.join(carry, on=keys, how="left")
    else:
        # (#groups x buckets) rows, bounded: prefix sums on the driver, broadcast back
        rows = sorted(totals.collect(), key=lambda r: (tuple(r[g] for g in groups), r[_B]))
        acc, before = {}, []
        for r in rows:
            g = tuple(r[g] for g in groups)
            now = acc.setdefault(g, [0] * len(names))
            before.append((*g, r[_B], *now))
            acc[g] = [a + (r[f"__tot{i}"] or 0) for i, a in enumerate(now)]
        schema = T.StructType([df.schema[g] for g in groups] + [T.StructField(_B, T.IntegerType())] +
                              [T.StructField(c, _sum_type(df.schema[v].dataType)) for c, v in zip(carried, names)])
        carry = df.sparkSession.createDataFrame(before, schema)
        joined = local.join(F.broadcast(carry), on=keys, how="left")
    sums = {out: F.col(f"__run{i}") + F.col(f"__carry{i}") - (F.lit(0) if inclusive else F.col(v))
            for i, (v, out) in enumerate(values.items())}
    return joined.withColumns(sums).drop(*carried, *[f"__run{i}" for i in range(len(names))], _B)


def _sum_type(dt):
    return T.DoubleType() if isinstance(dt, (T.FloatType, T.DoubleType)) else T.LongType()


def average_ranks(values: DataFrame, value: str, partition_by=(), out: str = "rank",
                  cuts_per_group: bool = False) -> DataFrame:
    """Distinct values of ``value`` (per group) with their average 1-based rank.

    Ties share the mean of their positions.  Works on frequencies, so a
    value held by a third of all rows is one row here.
    """
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    freq = (values.where(F.col(value).isNotNull())
            .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__cnt")))
    ranked = running_sum(freq, "__cnt", value, groups, out="__before", cuts_per_group=cuts_per_group)
    return ranked.select(*groups, value, F.col("__cnt").alias("cnt"),
                         (F.col("__before") + (F.col("__cnt") + 1) / 2.0).alias(out))
