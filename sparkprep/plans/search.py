"""Hyperparameter search: grids, draws from distributions, successive halving.

Every candidate is scored by cross-validation over folds that come from the key's hash.  The
feature encoder and the class codes are fitted again in every fold, on its training rows alone, so a
score never sees what the fold holds out.  With successive halving a rung trains on a share of each
fold's training rows, also picked by the key's hash: a smaller share is always part of a larger one,
and only the best candidates of a rung go on to the next, until the last trains on all rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.types import encodable_columns
from ..operators import boosting
from ..operators import metrics as M
from ..operators.encode import fit_label_encoding
from ..operators.models import FEATURES, LABEL, FittedModel
from ..operators.split import hash_unit
from .features import FeatureEncoder

SCALE = 16 ** 6                # hash_unit's range


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform:
    """Evenly over the exponents: each tenfold range is as likely."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class Integers:
    """Whole numbers, both ends included."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


def grid(values: dict) -> list[dict]:
    """Every combination of the listed values."""
    names = sorted(values)
    return [dict(zip(names, combo)) for combo in product(*(values[n] for n in names))]


def draws(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` candidates drawn independently; the same for the same seed, whatever the order of ``space``."""
    rng = random.Random(seed)
    return [{name: space[name].draw(rng) for name in sorted(space)} for _ in range(n)]


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    return (hash_unit(key, seed + 1) % folds).cast("int")


def in_budget(key: str, share: float, seed: int = 42) -> Column:
    """Whether a row is among the first ``share`` of the rows; a larger share holds all rows of a smaller."""
    return hash_unit(key, seed + 2) < F.lit(math.ceil(SCALE * share))


def shares(rungs: int, factor: int = 3) -> list[float]:
    """Row shares of the rungs: each ``factor`` times the one before, the last 1."""
    return [1.0 / factor ** (rungs - 1 - r) for r in range(rungs)]


def budget_rows(df: DataFrame, key: str, folds: int = 3, rungs: int = 3, factor: int = 3, seed: int = 42) -> DataFrame:
    """``(rung, fold, train_rows, held_out_rows)``: the rows that each rung and fold of a search trains and scores on."""
    counted = df.groupBy(fold_of(key, folds, seed).alias("of")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(in_budget(key, s, seed)).alias(f"b{r}") for r, s in enumerate(shares(rungs, factor))])
    # a row a fold: few enough to pair with the folds
    wide = counted.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "*")
    summed = wide.groupBy("fold").agg(
        F.sum(F.when(F.col("of") == F.col("fold"), F.col("n")).otherwise(0)).alias("held_out_rows"),
        *[F.sum(F.when(F.col("of") != F.col("fold"), F.col(f"b{r}")).otherwise(0)).alias(f"b{r}") for r in range(rungs)])
    rows = F.array(*[F.struct(F.lit(r).alias("rung"), F.col(f"b{r}").alias("train_rows")) for r in range(rungs)])
    return summed.select("fold", "held_out_rows", F.explode(rows).alias("r")).select(
        "r.rung", "fold", "r.train_rows", "held_out_rows")


@dataclass
class Search:
    """``make(params)`` gives an MLlib estimator, or ``boosting.Settings``."""

    target: str
    key: str
    problem: str
    make: Callable
    folds: int = 3
    seed: int = 42
    factor: int = 3
    metric: str | None = None           # default: f1 (macro, of two classes the second's) or r2
    encoding: str = "label"
    scaler: str = "none"

    def _fold(self, df: DataFrame, fold: int, share: float):
        """(train, held out, width, classes) of a fold, encoded by its own training rows, persisted."""
        of = fold_of(self.key, self.folds, self.seed)
        train = df.where((of != fold) & in_budget(self.key, share, self.seed))
        feats = [c for c in df.columns if c not in (self.key, self.target)]
        text = encodable_columns(df.select(*[F.col(f"`{c}`") for c in feats]))
        label = self.encoding == "label"
        encoder = FeatureEncoder(labelCols=text if label else [], oneHotCols=[] if label else text,
                                 sparse=self.encoding == "sparse", scaler=self.scaler, excludeCols=[self.key, self.target],
                                 outputCol=FEATURES).fit(train)
        codes = None
        if self.problem == "classification":
            codes = fit_label_encoding(train.select(F.col(f"`{self.target}`").alias(LABEL)), [LABEL])

        def made(part):
            part = part.withColumn(LABEL, F.col(f"`{self.target}`").cast("double" if codes is None else "string"))
            part = part if codes is None else codes.apply(part).withColumn(LABEL, F.col(LABEL).cast("double"))
            return encoder.transform(part).select(self.key, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)

        return made(train), made(df.where(of == fold)), len(encoder.slots), None if codes is None else codes.sizes[LABEL]

    def _score(self, params: dict, train: DataFrame, held: DataFrame, rows: int, width: int, classes: int | None) -> float:
        made = self.make(params)
        if isinstance(made, boosting.Settings):
            model = FittedModel("", "blocks", boosting.fit(train, FEATURES, LABEL, classes, width, rows, made), [], problem=self.problem)
        else:
            model = FittedModel("", "mllib", made.setFeaturesCol(FEATURES).setLabelCol(LABEL).fit(train), [], problem=self.problem)
        pred = model.predict(held)
        if self.problem == "classification":
            row = M.classification_metrics(pred, LABEL, "prediction", 1.0, "binary" if classes == 2 else "macro", digits=12).first()
            return row[self.metric or "f1"]
        row = M.regression_metrics(pred, LABEL, "prediction", digits=12).first()
        return row[self.metric or "r2"]

    @property
    def _sign(self) -> int:
        return -1 if self.metric in ("mae", "mse", "rmse") else 1

    def run(self, df: DataFrame, candidates: list[dict], rungs: int = 1) -> tuple[dict, DataFrame]:
        """The best candidate, and ``(rung, share, train_rows, candidate, params, score, kept)`` of all that were scored.

        score is the mean over the folds; equal scores go to the candidate that comes first.  The last
        rung keeps the winner alone.  One rung is plain cross-validation of every candidate.
        """
        left, log = list(range(len(candidates))), []
        for rung, share in enumerate(shares(rungs, self.factor)):
            total, used = dict.fromkeys(left, 0.0), 0
            for fold in range(self.folds):
                train, held, width, classes = self._fold(df, fold, share)
                rows = train.count()
                used += rows
                for i in left:
                    total[i] += self._score(candidates[i], train, held, rows, width, classes) / self.folds
                train.unpersist()
                held.unpersist()
            order = sorted(left, key=lambda i: (-self._sign * total[i], i))
            keep = 1 if rung == rungs - 1 else max(1, -(-len(order) // self.factor))
            for i in order:
                text = ", ".join(f"{k}={v}" for k, v in sorted(candidates[i].items()))
                log.append((rung, share, used, i, text, round(total[i], 6), i in order[:keep]))
            left = sorted(order[:keep])
        frame = df.sparkSession.createDataFrame(
            log, "rung int, share double, train_rows long, candidate int, params string, score double, kept boolean")
        return candidates[left[0]], frame
