"""Helpers shared by the training-data operators: scratch tables, row keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage at files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of an Arrow batch: whole texts can be long, and a task holds several batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, as the setting applies when a plan runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, underscored until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with a unique long per row that ascends with ``id_col``, and that column's name.

    Integer ids that are unique and never null are the key themselves.  Otherwise rows are
    numbered in the order of id (null last), then text, then arrival, by a distributed sort,
    and the numbered rows are written to the scratch folder.
    """
    small_batches(df.sparkSession)
    name = free_name(df, "row_key")
    ident = F.col(f"`{id_col}`")
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        most = df.groupBy(ident.alias("id")).agg(F.count("*").alias("n")).agg(
            F.max(F.when(F.col("id").isNull(), F.lit(2)).otherwise(F.col("n"))).alias("n")).first()["n"]
        if (most or 1) == 1:
            return df.withColumn(name, ident.cast("long")), name
    name = free_name(df, "row_number")
    ordered = df.orderBy(ident.asc_nulls_last(), F.col(f"`{text_col}`"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    numbered = ordered.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return save(df.sparkSession.createDataFrame(numbered, schema, verifySchema=False), "numbered"), name


def text_of(text_col: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, id, text)`` of ``keyed``."""
    rows, key = keyed(df, id_col, text_col)
    return rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))


_STEPS = ((13, True), (7, False), (17, True))      # shifts of the scrambling, and whether to the left


def _shifted(x: Column, by: int, left: bool) -> Column:
    return F.shiftleft(x, by) if left else F.shiftrightunsigned(x, by)


def _scrambled(x: Column) -> Column:
    """A permutation of the longs, so that the order of node ids says nothing about the graph."""
    for by, left in _STEPS:
        x = x.bitwiseXOR(_shifted(x, by, left))
    return x


def _unscrambled(x: Column) -> Column:
    for by, left in reversed(_STEPS):
        y = x
        for k in range(by, 64, by):
            y = y.bitwiseXOR(_shifted(x, k, left))
        x = y
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` with the smallest node of each component, for nodes on any edge.

    Every round gives each node the smallest label of its closed neighbourhood (a map-side
    combined aggregate) and contracts the edges to those labels, until no edge is left; ids are
    scrambled first, so chains shrink by a constant share each round whatever their order.  The
    rounds' labels are then composed.  All tables go through the scratch folder, so both sides of
    each join are plain scans and Spark can split the rows of a hub; no neighbourhood is gathered.
    """
    # written, as both the loops and the edges proper are read from it
    ends = save(edges.select(_scrambled(F.col(a)).alias("a"), _scrambled(F.col(b)).alias("b")), "cc_ends")
    loops = save(ends.where("a = b").select("a").distinct(), "cc_loops")
    current = save(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                   "cc_edges")
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = save(both.groupBy("a").agg(F.min("b").alias("b"))
                      .select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "cc_labels")
        rounds.append(labels)
        left, right = (labels.select(F.col("node").alias(f"n{i}"), F.col("label").alias(f"l{i}")) for i in (1, 2))
        moved = (current.join(left, F.col("a") == F.col("n1")).join(right, F.col("b") == F.col("n2"))
                 .where("l1 <> l2").select(F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b")))
        current = save(moved.distinct(), "cc_edges")
    if not rounds:
        return loops.select(_unscrambled(F.col("a")).alias("node"), _unscrambled(F.col("a")).alias("component"))
    roots = rounds[-1]
    for labels in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("of"), F.col("label").alias("root"))
        roots = save(labels.join(later, F.col("label") == F.col("of"), "left")
                     .select("node", F.coalesce("root", "label").alias("label")), "cc_roots")
    named = roots.select(_unscrambled(F.col("node")).alias("node"), "label")
    lows = save(named.groupBy(F.col("label").alias("of")).agg(F.min("node").alias("component")), "cc_lows")
    found = named.join(lows, F.col("label") == F.col("of")).select("node", "component")
    alone = loops.join(roots, F.col("a") == F.col("node"), "left_anti").select(_unscrambled(F.col("a")).alias("node"))
    return found.union(alone.select("node", F.col("node").alias("component")))


def hex64(value: Column) -> Column:
    """Sixteen lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
