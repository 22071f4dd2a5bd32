"""Feature plan: label / one-hot encoding, then scaling (codes and dummies too).

``fit`` learns everything from one frame (the training part, so nothing
leaks from test rows); ``apply`` is a pure projection (wide mappings are
joined) usable on any frame, streaming ones included.  ``FeatureEncoder``
is the same plan as a stage of an ``ml.Pipeline``: it can be fitted inside
a fold, saved with the model and loaded where there is no training data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

from ..functions.types import numeric_columns
from ..operators.encode import LabelEncoding, OneHotEncoding, fit_label_encoding, fit_onehot
from ..operators.scale import Scaler, fit_scaler


@dataclass
class FeaturePlan:
    label_cols: list = field(default_factory=list)
    onehot_cols: list = field(default_factory=list)
    scaler: str | None = "standard"            # "standard" | "minmax" | None
    exclude: list = field(default_factory=list)   # keys / target: never scaled
    sparse: bool = False                       # one-hot columns as sparse vectors

    def fit(self, df: DataFrame) -> "FittedFeaturePlan":
        labels = fit_label_encoding(df, self.label_cols)
        encoded = labels.apply(df)
        onehot = fit_onehot(encoded, self.onehot_cols, self.sparse)
        encoded = onehot.apply(encoded)
        scaler = None
        if self.scaler:
            scaler = fit_scaler(encoded, self.scaler, numeric_columns(encoded, exclude=self.exclude))
        return FittedFeaturePlan(labels, onehot, scaler)


@dataclass
class FittedFeaturePlan:
    labels: LabelEncoding
    onehot: OneHotEncoding
    scaler: Scaler | None

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.onehot.apply(self.labels.apply(df))
        return self.scaler.apply(out) if self.scaler else out


class _FeatureParams(Params):
    labelCols = Param(Params._dummy(), "labelCols", "text columns that become codes", TypeConverters.toListString)
    oneHotCols = Param(Params._dummy(), "oneHotCols", "columns that become 0/1 columns", TypeConverters.toListString)
    sparse = Param(Params._dummy(), "sparse", "one-hot columns as sparse vectors", TypeConverters.toBoolean)
    scaler = Param(Params._dummy(), "scaler", "standard, minmax or none", TypeConverters.toString)
    excludeCols = Param(Params._dummy(), "excludeCols", "keys and target: neither scaled nor assembled",
                        TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of all features; empty: none is made", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCols=[], oneHotCols=[], sparse=False, scaler="none", excludeCols=[], outputCol="")


class FeatureEncoder(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of a feature plan; every statistic comes from the frame it is fitted on."""

    @keyword_only
    def __init__(self, *, labelCols=None, oneHotCols=None, sparse=None, scaler=None, excludeCols=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeatureEncoderModel":
        kind = self.getOrDefault("scaler")
        excluded = self.getOrDefault("excludeCols")
        plan = FeaturePlan(self.getOrDefault("labelCols"), self.getOrDefault("oneHotCols"), None if kind == "none" else kind,
                           excluded, self.getOrDefault("sparse")).fit(dataset)
        features = [c for c in plan.apply(dataset.limit(0)).columns if c not in excluded]
        return self._copyValues(FeatureEncoderModel(plan, features))


class FeatureEncoderModel(Model, _FeatureParams, MLWritable, MLReadable):
    """A fitted feature plan; ``features`` are the columns it makes, in the order of the vector."""

    def __init__(self, plan: FittedFeaturePlan | None = None, features: list | None = None):
        super().__init__()
        self.plan, self.features = plan, features or []

    @property
    def slots(self) -> list[str]:
        """A name for each place of the assembled vector."""
        vectors = self.plan.onehot.sparse.sizes if self.plan.onehot.sparse is not None else {}
        return [s for c in self.features for s in
                ([f"{c}_{i}" for i in range(vectors[c[:-len("_onehot")]])]
                 if c.endswith("_onehot") and c[:-len("_onehot")] in vectors else [c])]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.plan.apply(dataset)
        name = self.getOrDefault("outputCol")
        if not name:
            return out
        return VectorAssembler(inputCols=self.features, outputCol=name, handleInvalid="keep").transform(out)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


def _encoding_state(enc: LabelEncoding | None) -> dict | None:
    return None if enc is None else {"mapping": enc.mapping, "sizes": enc.sizes, "wide": list(enc.tables),
                                     "null_as_text": enc.null_as_text}


class _ModelWriter(MLWriter):
    """Metadata with the small parts; a wide mapping is a Parquet table beside it."""

    def __init__(self, model: FeatureEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        plan = self.model.plan
        state = {"labels": _encoding_state(plan.labels), "sparse": _encoding_state(plan.onehot.sparse),
                 "categories": plan.onehot.categories, "features": self.model.features,
                 "scaler": None if plan.scaler is None else {"kind": plan.scaler.kind, "stats": plan.scaler.stats}}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"plan": state})
        for part, enc in (("labels", plan.labels), ("sparse", plan.onehot.sparse)):
            for i, table in enumerate((enc.tables if enc else {}).values()):
                table.select("value", "code").write.parquet(f"{path}/{part}_{i}")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureEncoderModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state = metadata["plan"]

        def encoding(part):
            held = state[part]
            if held is None:
                return None
            tables = {c: spark.read.parquet(f"{path}/{part}_{i}") for i, c in enumerate(held["wide"])}
            return LabelEncoding(held["mapping"], tables, held["sizes"], held["null_as_text"])

        scaler = state["scaler"]
        plan = FittedFeaturePlan(encoding("labels"), OneHotEncoding(state["categories"], encoding("sparse")),
                                 scaler and Scaler(scaler["kind"], {c: tuple(v) for c, v in scaler["stats"].items()}))
        model = self.cls(plan, state["features"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
