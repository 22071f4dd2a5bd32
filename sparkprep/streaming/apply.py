"""Apply a fitted row-wise cleaning plan to a Structured Streaming source.

Fitting needs whole-table statistics (modes, medians, IQR fences, scaler
moments), so it runs on a static snapshot; every step of the fitted plan
is a projection with literal constants, which Structured Streaming runs
per micro-batch without state.  Checkpoints go under the cluster's
``spark.checkpoint.dir`` so a restarted query resumes exactly once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_SENTINELS
from ..functions.types import numeric_columns, text_columns
from ..operators import clean, impute, outliers
from ..session import ensure_checkpoint_dir


@dataclass
class RowPlan:
    """Fitted constants; ``apply`` is a pure projection (batch or stream)."""
    convert: list = field(default_factory=list)
    sentinels: list = field(default_factory=list)
    sentinel_cols: list = field(default_factory=list)
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = clean.convert_columns(df, self.convert)
        if self.sentinels:
            out = clean.mask_sentinels(out, [c for c in self.sentinel_cols if c in out.columns], self.sentinels)
        if self.medians:
            out = out.select(*[F.col(c).cast("double").alias(c) if c in self.medians else F.col(c)
                               for c in out.columns])
        out = impute.fill_constants(out, {**self.medians, **self.modes})
        return outliers.cap_columns(out, self.fences) if self.fences else out


def fit_row_plan(df: DataFrame, key: str | None = None, sentinels=None, cap: bool = True) -> RowPlan:
    """Learn a row-wise plan on a static frame: coerce -> mask -> median/mode fill -> cap."""
    fit = clean.classify_dirty_numerics(df)
    conv = clean.convert_columns(df, fit.dirty)
    codes = list(DEFAULT_SENTINELS if sentinels is None else sentinels)
    nums = [c for c in numeric_columns(conv) if c != key]
    masked = clean.mask_sentinels(conv, nums, codes) if codes else conv
    _, medians = impute.median_fill(masked, nums)
    _, modes = impute.mode_fill(masked, text_columns(masked))
    fences = {}
    if cap and nums:
        _, fences = outliers.cap_all(impute.fill_constants(
            masked.select(*[F.col(c).cast("double").alias(c) if c in medians else F.col(c)
                            for c in masked.columns]), medians), nums)
    return RowPlan(fit.dirty, codes, nums, medians, modes, fences)


@dataclass
class ScoringPlan:
    """Cleaning, encoding, scaling and prediction as one fitted plan for batches and streams.

    Every part is a projection, or a join of the stream with a static mapping of a wide column, so
    no state is kept.  A k-NN model compares rows with the training table and cannot run on a stream.
    """
    rows: RowPlan | None = None
    encoder: object = None               # FeatureEncoderModel
    model: object = None                 # FittedModel

    def __post_init__(self):
        if self.model is not None and self.model.kind == "knn":
            raise ValueError("a k-NN model joins its training rows and cannot score a stream")

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.rows.apply(df) if self.rows else df
        out = self.encoder.transform(out) if self.encoder else out
        return self.model.predict(out) if self.model else out


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A streaming read of one Parquet table file in ``directory``."""
    schema = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(directory))


def run_to_table(stream: DataFrame, query_name: str | None = None) -> DataFrame:
    """Drain a stream into Parquet files in the shared folder and read them back.

    Rows go from the executors to the files; none passes the driver.
    """
    spark = stream.sparkSession
    name = query_name or f"sparkprep_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream_{name}"
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/data").outputMode("append")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def write_stream(stream: DataFrame, path: str, query_name: str):
    """Production sink: Parquet files, exactly-once through the checkpoint folder."""
    spark = stream.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream_{query_name}"
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", ckpt).outputMode("append").start())
