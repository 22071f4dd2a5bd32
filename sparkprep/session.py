"""Session helpers: a local session for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sparkprep") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARKPREP_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only set one when unset.

    On a cluster that setting names a shared, fault-tolerant folder, and
    without it this is an error: executors do not share local folders.  A
    fresh local folder is created only for a local master (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="sparkprep-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back, which cuts its lineage.

    Used where a fitted plan reads the same intermediate several times; a
    lost executor then re-reads files instead of recomputing every upstream
    shuffle.  The plan runs once (a reliable ``checkpoint()`` runs it
    twice).  Columns are named by their place in the files, so any names go.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage_{uuid.uuid4().hex}"
    fields = [T.StructField(f"c{i}", T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType)
              for i, f in enumerate(df.schema.fields)]
    named = df.toDF(*[f.name for f in fields])
    named.select(*[F.col(f.name).cast(f.dataType) if isinstance(g.dataType, T.NullType) else F.col(f.name)
                   for f, g in zip(fields, df.schema.fields)]).write.parquet(path)
    return spark.read.schema(T.StructType(fields)).parquet(path).toDF(*df.columns)


def observed(df: DataFrame, **aggregates) -> tuple[DataFrame, Observation]:
    """``df`` with named aggregates that the action which writes it also computes.

    Place it after the last shuffle: a task that has to run again further up would be counted twice.
    """
    seen = Observation()
    return df.observe(seen, *[expr.alias(name) for name, expr in aggregates.items()]), seen


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
