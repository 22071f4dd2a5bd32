"""Supervised model zoo with a uniform predict interface.

Every model yields ``prediction`` (label index, double) and, where it has
one, ``probs`` (array<double> of class probabilities).  Linear models and trees
are MLlib's, and so are forests whose rows have many cells (``forest`` has the
others).  Boosted trees (``boosting``) and the kernel SVM (``kernel_svm``) are
fitted by passes that serve all classes at once; the kernel regressor is random
Fourier features with a huber regression, MLlib's where the projected rows are
few enough to be held, otherwise by passes over blocks.
The kernels are approximated, so these stand for the single-machine
solvers and do not reproduce them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import knn_predict

FEATURES = "features"
LABEL = "label"


@dataclass
class FittedModel:
    name: str
    kind: str              # "mllib" | "knn" | "blocks" (boosted trees, kernel machines, forests of cells)
    model: object
    features: list
    rff: object = None
    train: DataFrame | None = None
    key: str | None = None
    k: int = 5
    problem: str = "classification"

    def predict(self, df: DataFrame) -> DataFrame:
        """Input must carry ``key``, ``features`` (vector) and optionally ``label``."""
        data = self.rff.apply(df) if self.rff else df
        if self.kind == "knn":
            tr = self.train.withColumn("__x", vector_to_array(FEATURES))
            te = data.withColumn("__x", vector_to_array(FEATURES))
            mode = "classify" if self.problem == "classification" else "regress"
            pred = knn_predict(tr, te, self.key, "__x", LABEL, self.k, mode)
            out = data.join(pred, on=self.key, how="left")
            if mode == "classify":
                top = self.train.agg(F.max(LABEL)).first()[0] or 0.0
                share = F.transform(F.sequence(F.lit(0), F.lit(int(top))),
                                    lambda i: F.coalesce(F.element_at("votes", i.cast("double")), F.lit(0.0)))
                out = out.withColumn("prediction", F.col("prediction").cast("double"))
                return out.withColumn("probs", share).drop("votes")
            return out
        if self.kind == "blocks":
            return self.model.apply(data, FEATURES)
        out = self.model.transform(data)
        if self.problem != "classification":
            return out
        if "probability" in out.columns:
            return out.withColumn("probs", vector_to_array("probability"))
        return out.withColumn("probs", F.lit(None).cast("array<double>"))

    def importances(self):
        imp = getattr(self.model, "featureImportances", None)
        if imp is None:
            return None
        return list(zip(self.features, [float(v) for v in imp.toArray()]))


class FourierFeatures:
    """Random Fourier features of the standardised inputs, as a vector column."""

    def __init__(self, fourier):
        self.fourier = fourier

    def apply(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        fourier = self.fourier

        @F.pandas_udf("array<double>")
        def mapped(x):
            import numpy as np
            import pandas as pd
            return pd.Series(list(fourier(np.stack(x.to_numpy()))[:, :-1])) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(FEATURES, array_to_vector(mapped(vector_to_array(FEATURES))))


@dataclass(frozen=True)
class Sizes:
    """Model sizes; the defaults are those every registered query runs with."""
    iterations: int = 1000        # logistic regression, at most
    trees: int = 100
    depth: int = 12               # of trees; the library allows 30, at a pass over the rows for each level
    rounds: int = 100             # of boosting
    boost_depth: int = 6
    svm_iterations: int = 100     # of the huber regression of the kernel regressor
    fourier: int = 256            # dimensions of the kernel approximation


def classifiers(sizes: Sizes = Sizes(), seed: int = 42) -> dict:
    """Name -> "knn", "svm", "boost", or a maker of an MLlib estimator from (rows, features)."""
    return {
        "Logistic Regression": lambda n, p: LogisticRegression(maxIter=sizes.iterations, regParam=1.0 / max(n, 1),
                                                               standardization=False),
        "Decision Tree": lambda n, p: DecisionTreeClassifier(maxDepth=sizes.depth, seed=seed),
        "Random Forest": lambda n, p: RandomForestClassifier(numTrees=sizes.trees, maxDepth=sizes.depth, cacheNodeIds=True,
                                                              seed=seed),
        "KNN": "knn",
        "SVM": "svm",
        "Gradient Boosted Trees": "boost",
    }


def regressors(sizes: Sizes = Sizes(), seed: int = 42) -> dict:
    return {
        "Linear Regression": lambda n, p: LinearRegression(regParam=0.0),
        "Decision Tree": lambda n, p: DecisionTreeRegressor(maxDepth=sizes.depth, seed=seed),
        "Random Forest": lambda n, p: RandomForestRegressor(numTrees=sizes.trees, maxDepth=sizes.depth, cacheNodeIds=True,
                                                            featureSubsetStrategy="all", seed=seed),
        "KNN Regressor": "knn",
        "SVR": lambda n, p: LinearRegression(loss="huber", maxIter=sizes.svm_iterations),
        "Gradient Boosted Trees": "boost",
    }


FOURIER_MODELS = {"SVR"}
FORESTS = {"Random Forest"}       # grown from counted cells where the rows have few (``forest``)
