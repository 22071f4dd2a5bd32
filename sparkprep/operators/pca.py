"""PCA on standardised complete rows (MLlib covariance + eigen decomposition).

The covariance is a distributed tree aggregate; only the p x p matrix
reaches the driver.  Scores keep every input column, so a category column
travels with its row (no index alignment).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import numeric_columns
from .clean import drop_on_critical
from .scale import fit_scaler


@dataclass
class PCAResult:
    features: list
    k: int
    explained: list            # ratio per component
    loadings: list             # [component][feature]
    scaler: object
    rows: int

    def evr_frame(self, spark) -> DataFrame:
        run, rows = 0.0, []
        for i, r in enumerate(self.explained):
            run += r
            rows.append((f"PC{i + 1}", i + 1, float(r) * 100.0, run * 100.0))
        return spark.createDataFrame(rows, "component string, idx int, explained_pct double, cumulative_pct double")

    def loadings_frame(self, spark, digits: int = 4) -> DataFrame:
        rows = [(f, f"PC{j + 1}", round(float(self.loadings[j][i]), digits))
                for j in range(self.k) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, component string, loading double")

    def summary_frame(self, spark) -> DataFrame:
        kept = sum(self.explained) * 100.0
        red = (1 - self.k / len(self.features)) * 100.0 if self.features else 0.0
        return spark.createDataFrame([(len(self.features), self.k, kept, red, self.rows)],
                                     "columns_before int, components int, retained_pct double, "
                                     "reduction_pct double, rows long")

    def scores(self, df: DataFrame, keep=()) -> DataFrame:
        """PC1..PCk for complete rows; ``keep`` columns (e.g. a category) travel along."""
        data = drop_on_critical(df, self.features)
        z = self.scaler.apply(data.select(*self.features, *keep))
        exprs = []
        for j in range(self.k):
            s = F.lit(0.0)
            for i, f in enumerate(self.features):
                s = s + F.col(f) * F.lit(float(self.loadings[j][i]))
            exprs.append(s.alias(f"PC{j + 1}"))
        return z.select(*keep, *exprs)


def run_pca(df: DataFrame, n_components: int = 3, cols=None) -> PCAResult:
    cols = numeric_columns(df) if cols is None else list(cols)
    data = drop_on_critical(df.select(*cols), cols)
    scaler = fit_scaler(data, "standard", cols)
    z = scaler.apply(data)
    n = data.count()
    k = max(1, min(n_components, len(cols), n))
    vec = VectorAssembler(inputCols=cols, outputCol="__f", handleInvalid="skip").transform(z)
    model = PCA(k=k, inputCol="__f", outputCol="__pc").fit(vec.select("__f"))
    pc = model.pc.toArray()                       # p x k
    loadings = []
    for j in range(k):
        col = [float(pc[i][j]) for i in range(len(cols))]
        big = max(range(len(cols)), key=lambda i: abs(col[i]))
        sign = 1.0 if col[big] >= 0 else -1.0     # deterministic sign: largest loading positive
        loadings.append([sign * v for v in col])
    evr = [float(v) for v in model.explainedVariance.toArray()]
    return PCAResult(cols, k, evr, loadings, scaler, n)
