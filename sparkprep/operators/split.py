"""Problem-type detection and reproducible train/test splits.

``randomSplit`` depends on partitioning; here a row's side is a pure
function of its key and the seed (md5), so any engine, partitioning or
recomputation gives the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CLASSIFICATION_MAX_DISTINCT
from ..session import materialize

_SCALE = 16777216  # 16^6: first six hex digits of the md5


def hash_unit(key, seed: int = 42) -> Column:
    """Integer in [0, 16^6) from md5(key ':' seed)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 6), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, test_ratio: float = 0.2, seed: int = 42):
    """(train, test): test when the key's hash falls below ratio * 16^6."""
    is_test = hash_unit(key, seed) < F.lit(int(_SCALE * test_ratio))
    return df.where(~is_test), df.where(is_test)


def stratified_split(df: DataFrame, key: str, label: str, test_ratio: float = 0.2, seed: int = 42):
    """Per class, the ceil(ratio * class size) rows with the smallest (hash, key) go to test.

    When some class has a single row it cannot be on both sides, and the
    split falls back to the plain one.  No class is gathered: rows are
    counted per class and the upper, then the lower twelve bits of the hash
    (4,096 rows a class at most), which gives the hash at which each class
    is cut; only rows with exactly that hash are ranked by key.  A null key counts as
    the empty text, rows of equal keys are ranked by all they hold, so that both parts agree on
    them, and a class of which no row is wanted is all train.
    """
    h = F.coalesce(hash_unit(F.col(f"`{key}`"), seed), hash_unit(F.lit(""), seed))
    cls = F.col(f"`{label}`")
    sizes = df.groupBy(cls.alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    if (sizes.agg(F.min("__n")).first()[0] or 0) == 1:
        is_test = h < F.lit(int(_SCALE * test_ratio))
        return df.where(~is_test), df.where(is_test)
    hashed = df.select(cls.alias("__c"), F.floor(h / 4096).alias("__hi"), (h % 4096).alias("__lo"))
    wanted = sizes.withColumn("__left", F.ceil(F.col("__n") * F.lit(test_ratio))).select("__c", "__left")

    def cut(counts: DataFrame, level: str, want: DataFrame) -> DataFrame:
        """Per class the level at which the wanted rows are reached, and the rows still wanted in it."""
        run = Window.partitionBy("__c").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counts.withColumn("__upto", F.sum("__k").over(run))
        both = summed.join(want.withColumnRenamed("__c", "__w"), F.col("__c").eqNullSafe(F.col("__w")))
        before = F.col("__upto") - F.col("__k")
        return (both.where((before < F.col("__left")) & (F.col("__upto") >= F.col("__left")))
                .select("__c", level, (F.col("__left") - before).alias("__left")))

    top = materialize(cut(hashed.groupBy("__c", "__hi").agg(F.count(F.lit(1)).alias("__k")), "__hi", wanted))
    at = top.select(F.col("__c").alias("__w"), F.col("__hi").alias("__at"))
    inner = hashed.join(at, F.col("__c").eqNullSafe(F.col("__w")) & (F.col("__hi") == F.col("__at")))
    low = cut(inner.groupBy("__c", "__lo").agg(F.count(F.lit(1)).alias("__k")), "__lo", top.select("__c", "__left"))
    cuts = materialize(top.select(F.col("__c").alias("__w"), "__hi").join(low, F.col("__c").eqNullSafe(F.col("__w")))
                       .select(F.col("__c").alias("__of"), (F.col("__hi") * 4096 + F.col("__lo")).alias("__cut"), "__left"))
    placed = df.join(cuts, cls.eqNullSafe(F.col("__of")), "left").withColumn("__h", h)
    # rows at the cut's own hash, few, are ranked by key; only rows of equal keys by all they hold
    at_cut = Window.partitionBy("__of", "__h", F.col(f"`{key}`")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
                                                                       *_orderable(df))
    edge = placed.where("__h = __cut").withColumn("__copy", F.row_number().over(at_cut))
    rank = F.row_number().over(Window.partitionBy("__of", "__h").orderBy(F.col(f"`{key}`"), "__copy"))
    edge = edge.withColumn("__test", rank <= F.col("__left")).drop("__copy")
    rest = (placed.where("__cut IS NULL OR __h <> __cut")
            .withColumn("__test", F.coalesce(F.col("__h") < F.col("__cut"), F.lit(False))))
    done = rest.unionByName(edge)
    cols = [F.col(f"`{c}`") for c in df.columns]
    return done.where("NOT __test").select(*cols), done.where("__test").select(*cols)


def _orderable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]


def split_sizes(n: int, test_ratio: float) -> tuple[int, int]:
    """Estimated (train, test) sizes shown before a split."""
    train = int(n * (1 - test_ratio))
    return train, n - train


# The split presets offered (test share).
SPLIT_PRESETS = {"70/30": 0.30, "80/20": 0.20, "90/10": 0.10}


def detect_problem_type(df: DataFrame, target: str,
                        max_classes: int = CLASSIFICATION_MAX_DISTINCT) -> str:
    """Text/bool -> classification; numeric with <= 20 distinct -> classification."""
    dt = df.schema[target].dataType
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return "classification"
    # distinct count capped: only whether it exceeds the limit matters
    few = df.select(target).where(F.col(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "classification" if few <= max_classes else "regression"
