"""Model metrics from small aggregate tables (never from collected rows).

Classification: every metric is derived from the counted (actual, predicted)
pairs, in Spark.  ROC AUC uses
the rank-sum form over score frequencies with distributed running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .order import running_sum


# The zero-filled matrix is built up to this many classes (a million cells).
MAX_GRID_CLASSES = 1000


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count) of the pairs that occur."""
    return (df.groupBy(F.col(f"`{actual}`").alias("actual"), F.col(f"`{predicted}`").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count) over the union of labels, zeros included.

    More than ``MAX_GRID_CLASSES`` labels are an error, as the matrix grows with their square;
    ``confusion_counts`` gives the cells that are not zero for any number.
    """
    counts = confusion_counts(df, actual, predicted)
    labels = (counts.select(F.explode(F.array("actual", "predicted")).alias("label")).where("label IS NOT NULL").distinct())
    if labels.limit(MAX_GRID_CLASSES + 1).count() > MAX_GRID_CLASSES:
        raise ValueError(f"more than {MAX_GRID_CLASSES} classes: use confusion_counts")
    every = labels.agg(F.array_sort(F.collect_list("label")).alias("labels"))       # one row, bounded above
    cells = (every.select(F.explode("labels").alias("actual"), "labels")
             .select("actual", F.explode("labels").alias("predicted"), F.lit(0).cast("long").alias("count")))
    return (cells.unionByName(counts.where("actual IS NOT NULL AND predicted IS NOT NULL"))
            .groupBy("actual", "predicted").agg(F.sum("count").alias("count")))


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive=None,
                           average: str | None = None, digits: int = 4) -> DataFrame:
    """accuracy, precision, recall, f1: binary on ``positive`` (default 1) when the
    actual column has two classes, macro otherwise; zero division -> 0.

    Works on the counted pairs, so any number of classes goes; rows without a label are left out."""
    counts = confusion_counts(df, actual, predicted).where("actual IS NOT NULL AND predicted IS NOT NULL")
    none = F.lit(0).cast("long")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("count").alias("support"), none.alias("pred"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(none).alias("tp")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"), F.col("count").alias("pred"),
                 none.alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("pred"))
    per = per.select("label", "tp", "support", "pred",
                     F.coalesce(F.try_divide(F.col("tp"), F.col("pred")), F.lit(0.0)).alias("p"),
                     F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)).alias("r"))
    per = per.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")),
                                         F.lit(0.0)))
    mode = average or ("binary" if counts.select("actual").distinct().limit(3).count() == 2 else "macro")
    if mode == "binary":
        pos = 1 if positive is None else positive
        # the positive class may be absent from the table: its metrics are then 0
        is_pos = F.col("label") == F.lit(pos)
        out = per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
                      F.coalesce(F.max(F.when(is_pos, F.col("p"))), F.lit(0.0)).alias("precision"),
                      F.coalesce(F.max(F.when(is_pos, F.col("r"))), F.lit(0.0)).alias("recall"),
                      F.coalesce(F.max(F.when(is_pos, F.col("f"))), F.lit(0.0)).alias("f1"))
    else:
        out = per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
                      F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))
    return out.select(*[F.round(c, digits).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """One row ``auc``: (sum of positives' average ranks - n1(n1+1)/2) / (n1 n0)."""
    return roc_auc_ovr(df, actual, {positive: score})


def roc_auc_ovr(df: DataFrame, actual: str, prob_cols: dict) -> DataFrame:
    """Macro one-vs-rest AUC: mean over classes of AUC(actual == c, prob_c).

    All classes are ranked together: one count of (class, score) and one running count along the scores of each.
    """
    sides = [F.struct(F.lit(i).alias("c"), F.col(f"`{col}`").cast("double").alias("s"), (F.col(f"`{actual}`") == F.lit(c)).alias("own"))
             for i, (c, col) in enumerate(prob_cols.items())]
    freq = (df.select(F.explode(F.array(*sides)).alias("x")).select("x.*").where("s IS NOT NULL")
            .groupBy("c", "s").agg(F.count(F.lit(1)).alias("cnt"), F.count_if("own").alias("npos")))
    ranked = running_sum(materialize(freq), "cnt", "s", ["c"], out="before", cuts_per_group=True)
    per = ranked.groupBy("c").agg(
        F.sum(F.col("npos") * (F.col("before") + (F.col("cnt") + 1) / 2.0)).alias("rs"),
        F.sum("npos").cast("double").alias("n1"), F.sum(F.col("cnt") - F.col("npos")).cast("double").alias("n0"))
    return per.agg(F.avg(F.try_divide(F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))).alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """MAE, MSE, RMSE, R2 (R2 = 1 - SSres/SStot; constant actual -> 1 if exact else 0)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    agg = df.agg(F.avg(F.abs(a - p)).alias("mae"), F.avg((a - p) * (a - p)).alias("mse"),
                 F.sum((a - p) * (a - p)).alias("ss_res"),
                 (F.var_pop(a) * F.count(a)).alias("ss_tot"))
    r2 = (F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("ss_res") / F.col("ss_tot")))
    return agg.select(F.round("mae", digits).alias("mae"), F.round("mse", digits).alias("mse"),
                      F.round(F.sqrt("mse"), digits).alias("rmse"), F.round(r2, digits).alias("r2"))


def best_model(results: DataFrame, metric: str, name_col: str = "model", order_col: str = "position") -> DataFrame:
    """Row with the highest ``metric`` (nulls ignored), else the first row."""
    return results.orderBy(F.col(metric).desc_nulls_last(), F.col(order_col).asc()).limit(1)


def compare(results: DataFrame, metric: str, lower_is_better=("mae", "mse", "rmse")) -> DataFrame:
    """Results sorted by a chosen metric: error metrics ascending, others descending."""
    asc = metric.lower() in lower_is_better
    return results.orderBy(F.col(metric).asc_nulls_last() if asc else F.col(metric).desc_nulls_last(),
                           F.col("position").asc())
