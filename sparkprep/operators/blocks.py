"""Rows as numeric blocks, for solvers that make many passes over the same training rows.

A block is one row of a small DataFrame: a few thousand training rows as one binary matrix.  A pass
is a ``mapInArrow`` over the blocks that yields partial sums as (slot, payload); ``summed`` adds the
payloads of a slot, in Spark, so what reaches the driver has the size of the model, not of the cluster.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

# The functions below travel to the Python workers by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_VALUES = 1 << 20         # matrix values of a block, about
TASK_ROWS = 20_000             # a task gets at least this many rows where there are as many

BLOCK = "n int, x binary, y binary, fold binary"


def _blocks(width: int, prepare):
    """Blocks of batches (features array<double>, label double, fold int); ``prepare`` maps the matrix once."""
    def run(batches):
        most = max(1, BLOCK_VALUES // max(1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                x = np.ascontiguousarray(prepare(x) if prepare else x)
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                fold = part.column(2).to_numpy(zero_copy_only=False).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.num_rows], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (x, y, fold)]],
                    ["n", "x", "y", "fold"])
    return run


def feature_blocks(df: DataFrame, features: str, label: str, width: int, rows: int, prepare=None,
                   fold=None) -> tuple[DataFrame, int]:
    """``df`` as checkpointed blocks (n, x, y, fold), and the number of tasks that read them.

    ``fold`` is an integer column below 100.
    """
    tasks = max(1, min(df.rdd.getNumPartitions(), -(-rows // TASK_ROWS)))
    flat = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                     (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    return materialize(flat.coalesce(tasks).mapInArrow(_blocks(width, prepare), BLOCK)), tasks


def each_block(batches, width: int, dtype):
    """(x, y, fold) arrays of the blocks in Arrow batches."""
    for batch in batches:
        for n, x, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
            yield (np.frombuffer(x, dtype).reshape(n, width), np.frombuffer(y, np.float64), np.frombuffer(fold, np.int8))


def slot_batch(slots, payloads):
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([p.tobytes() for p in payloads], pa.binary())],
                                      ["slot", "payload"])


def _add(finish):
    def run(batches):
        total: dict = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.float64)
                total[slot] = total[slot] + part if slot in total else part
        if total:
            yield slot_batch(list(total), [finish(slot, v) for slot, v in total.items()])
    return run


def summed(parts: DataFrame, tasks: int, slots: int, finish=None) -> dict[int, np.ndarray]:
    """slot -> sum of its payloads (doubles), after ``finish(slot, sum)``, which runs in the tasks.

    The driver receives one row a slot.  The payloads of a single task need no shuffle to meet.
    """
    if tasks > 1:
        parts = parts.repartition(max(1, min(slots, shuffle_partitions(parts.sparkSession))), "slot")
    added = parts.mapInArrow(_add(finish or (lambda slot, v: v)), "slot long, payload binary")
    return {r["slot"]: np.frombuffer(r["payload"], np.float64) for r in added.collect()}
