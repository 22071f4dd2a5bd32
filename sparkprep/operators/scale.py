"""Min-max and standard scaling from one aggregate (population std).

MLlib's MinMaxScaler maps constant columns to 0.5 and its StandardScaler
uses the n-1 std; the reference maps constants to 0 and uses the
population std, so both scalers are plain expressions here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..functions.types import numeric_columns


@dataclass
class Scaler:
    kind: str                                      # "minmax" | "standard"
    stats: dict = field(default_factory=dict)      # column -> (a, b): minmax (min, max); standard (mean, std)

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.stats:
                out.append(F.col(f"`{c}`"))
                continue
            a, b = self.stats[c]
            v = nan_to_null(F.col(f"`{c}`").cast("double"))
            if a is None:
                out.append(v.alias(c))
            elif self.kind == "minmax":
                rng = b - a
                out.append((F.lit(0.0) * v if rng == 0 else (v - F.lit(a)) / F.lit(rng)).alias(c))
            else:
                out.append((F.lit(0.0) * v if not b else (v - F.lit(a)) / F.lit(b)).alias(c))
        return df.select(*out)


def fit_scaler(df: DataFrame, kind: str = "standard", cols=None) -> Scaler:
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return Scaler(kind)
    if kind == "minmax":
        aggs = [F.min(nan_to_null(F.col(f"`{c}`").cast("double"))) for c in cols] + \
               [F.max(nan_to_null(F.col(f"`{c}`").cast("double"))) for c in cols]
    elif kind == "standard":
        aggs = [F.avg(nan_to_null(F.col(f"`{c}`").cast("double"))) for c in cols] + \
               [F.stddev_pop(nan_to_null(F.col(f"`{c}`").cast("double"))) for c in cols]
    else:
        raise ValueError(kind)
    row = df.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).collect()[0]
    k = len(cols)
    return Scaler(kind, {c: (row[f"s{i}"], row[f"s{i + k}"]) for i, c in enumerate(cols)})
