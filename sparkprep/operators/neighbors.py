"""k-nearest-neighbour imputation and models on the exact pivot join (``pivots``).

Imputation: rows are taken by the coordinates they have.  A gap is filled
from donors that have the column; a recipient and a donor are compared on
the coordinates both have, scaled up to all of them (NaN-aware Euclidean
distance).  Each (column to fill, recipient pattern, donor pattern) is a
lane of one pivot join, so lanes share all passes; the nearest of a
recipient's lanes are merged afterwards.  Patterns are bounded by the
schema, in practice a handful.

Models: one lane over the whole feature vector, for any number of training
rows; none is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from .pivots import nearest


def _presence(cols: list[str]) -> Column:
    """The pattern of a row: a set of the columns it has, as the text of their places."""
    return F.concat_ws(",", *[F.when(F.col(f"`{c}`").isNotNull(), F.lit(str(i))) for i, c in enumerate(cols)])


def _patterns(rows: DataFrame, cols: list[str]) -> list[frozenset]:
    found = rows.select(_presence(cols).alias("p")).distinct().collect()          # bounded by the schema
    return sorted((frozenset(int(i) for i in r["p"].split(",") if i) for r in found), key=sorted)


def _in_lanes(rows: DataFrame, key: str, cols: list[str], lanes: list, side: str, value: Column) -> DataFrame:
    """(lane, key, x, y) of every lane a row belongs to, by its pattern."""
    pattern = _presence(cols)
    entries = []
    for number, lane in enumerate(lanes):
        text = ",".join(str(i) for i in sorted(lane[side]))
        entries.append(F.when(F.col("__p") == text, F.struct(
            F.lit(number).alias("lane"), F.array(*[F.col(f"`{cols[i]}`") for i in sorted(lane["shared"])]).alias("x"),
            value(lane).alias("y"))))
    return (rows.withColumn("__p", pattern).select(F.col("__key").alias(key), F.explode(F.array_compact(F.array(*entries))).alias("e"))
            .select("e.lane", key, "e.x", "e.y"))


def knn_impute(df: DataFrame, key: str, cols: list[str], k: int = 5) -> DataFrame:
    """Fill gaps in ``cols`` from the k nearest rows.

    NaN-aware Euclidean distance on the raw ``cols``; inverse-distance
    weights; if a chosen donor is at distance 0, the zero-distance donors
    alone are averaged; equal distances go by key; a row sharing no
    coordinate with any donor gets the column mean.  Columns that are
    entirely null are left as they are.  ``key`` must be unique.
    """
    base = df.select(F.col(f"`{key}`").alias("__key"), *[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    st = base.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    have = {c: st[f"n{i}"] for i, c in enumerate(cols)}
    mean = {c: st[f"m{i}"] for i, c in enumerate(cols)}
    usable = [c for c in cols if have[c] > 0]
    targets = [c for c in usable if have[c] < st["__n"]]
    if not targets:
        return df
    patterns = _patterns(base, usable)
    lanes = []
    for place, c in enumerate(usable):
        if c not in targets:
            continue
        for mine in patterns:
            for theirs in patterns:
                shared = mine & theirs
                if place not in mine and place in theirs and shared:
                    lanes.append({"target": c, "recipient": mine, "donor": theirs, "shared": shared})
    fills = None
    if lanes:
        asked = _in_lanes(base, "q", usable, lanes, "recipient", lambda lane: F.lit(0.0)).drop("y")
        donors = _in_lanes(base, "key", usable, lanes, "donor", lambda lane: F.col(f"`{lane['target']}`"))
        factors = {i: float(len(usable)) / len(lane["shared"]) for i, lane in enumerate(lanes)}
        found = nearest(asked, donors, k, factors).rows
        target = F.element_at(F.array(*[F.lit(targets.index(lane["target"])) for lane in lanes]), F.col("lane") + 1)
        best = Window.partitionBy("q", "target").orderBy("d", "key")
        top = (found.withColumn("target", target).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k))
        zero = F.col("d") == 0
        per = top.groupBy("q", "target").agg(
            F.count_if(zero).alias("z"), F.avg(F.when(zero, F.col("y"))).alias("zero_mean"),
            F.try_divide(F.sum(F.try_divide(F.col("y"), F.col("d"))), F.sum(F.try_divide(F.lit(1.0), F.col("d")))).alias("weighted"))
        fill = F.when(F.col("z") > 0, F.col("zero_mean")).otherwise(F.col("weighted"))
        fills = per.groupBy("q").agg(*[F.max(F.when(F.col("target") == i, fill)).alias(f"__fill{i}") for i in range(len(targets))])
    out = df.withColumn("__key", F.col(f"`{key}`"))
    if fills is not None:
        out = out.join(fills.withColumnRenamed("q", "__key"), on="__key", how="left")

    def filled(c):
        near = [F.col(f"__fill{targets.index(c)}")] if fills is not None else []
        return F.coalesce(nan_to_null(F.col(f"`{c}`").cast("double")), *near, F.lit(mean[c])).alias(c)

    return out.select(*[filled(c) if c in targets else F.col(f"`{c}`") for c in df.columns])


def knn_predict(train: DataFrame, test: DataFrame, key: str, features: str, label: str, k: int = 5,
                mode: str = "classify") -> DataFrame:
    """k-NN classifier (majority vote, smallest label on ties; vote shares by label as ``votes``)
    or regressor (uniform mean) over an array<double> column.

    Exact, at any size.  ``key`` must be unique in both frames; a test row with a null or missing
    coordinate, or without any training row, gets no result.
    """
    donors = train.select(F.lit(0).alias("lane"), F.col(f"`{key}`").alias("key"), F.col(features).cast("array<double>").alias("x"),
                          F.col(label).alias("y"))
    asked = test.select(F.lit(0).alias("lane"), F.col(f"`{key}`").alias("q"), F.col(features).cast("array<double>").alias("x"))
    top = nearest(asked, donors, k).rows.select(F.col("q").alias("l_key"), F.col("y").alias("r_y"))
    return _vote(top, key, mode)


def _vote(top: DataFrame, key: str, mode: str) -> DataFrame:
    if mode == "regress":
        return top.groupBy("l_key").agg(F.avg("r_y").alias("prediction")).withColumnRenamed("l_key", key)
    votes = top.groupBy("l_key", "r_y").agg(F.count(F.lit(1)).alias("__votes"))
    best = votes.groupBy("l_key").agg(
        F.min(F.struct((-F.col("__votes")).alias("v"), F.col("r_y").alias("y"))).alias("__b"),
        F.sum("__votes").alias("__tot"), F.collect_list(F.struct("r_y", "__votes")).alias("__all"))   # k at most
    share = F.map_from_entries(F.transform("__all", lambda e: F.struct(
        e["r_y"].cast("double").alias("y"), (e["__votes"] / F.col("__tot")).alias("s"))))
    return best.select(F.col("l_key").alias(key), F.col("__b.y").alias("prediction"),
                       (-F.col("__b.v") / F.col("__tot")).alias("confidence"), share.alias("votes"))
