"""Centroid clustering of integer vectors over an incremental distance matrix.

Method: with every vector its exact inner products with all centroids are kept.  After a round only
those components of a centroid that changed touch its column: the product grows by the vector's
component times the change.  Distances follow as |x|^2 - 2 x.c + |c|^2, and the assignment is their
argmin, in whole numbers throughout.

The table of (id, vector, products) is persisted (memory, then disk) from round to round and
written out every ``CUT_ROUNDS`` rounds; a lost executor's part is made again from the last written
table by that many narrow passes.  No pass shuffles a vector: tasks add up their clusters, and one
row for each cluster and component reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import save, small_batches

CUT_ROUNDS = 5


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int = 1024) -> DataFrame:
    """``(id, v array<long>)``: floor(scale * x), x as double, of vectors of ``size`` finite components.

    Rows with another length or a null or non-finite component are left out; a null id stays.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where((F.size(v) == size) & finite).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.transform(v.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in whole numbers; by doubles where every partial sum is below 2**53."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(w).max(initial=0)) * max(1, x.shape[1]) < 2.0 ** 52:
        return (x.astype(np.float64) @ w.astype(np.float64)).astype(np.int64)
    return x @ w


def distances(x: np.ndarray, dots: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * dots + (centers * centers).sum(axis=1)[None, :]


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray):
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _first(centers: np.ndarray):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), centers.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(product(x, centers.T))], ["id", "v", "dots"])
    return run


def moved(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Products after each centroid's ``change``, from its changed components alone."""
    dots = dots.copy()
    for j, row in enumerate(change):
        at = np.flatnonzero(row)
        if len(at):
            dots[:, j] += product(x[:, at], row[at])
    return dots


def _advance(change: np.ndarray):
    def run(batches):
        for b in batches:
            x, dots = _matrix(b.column(1), change.shape[1]), _matrix(b.column(2), len(change))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(moved(x, dots, change))], ["id", "v", "dots"])
    return run


def _sums(centers: np.ndarray):
    """One row a task and cluster: members and the sum of each component."""
    def run(batches):
        k, width = centers.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            own = distances(x, _matrix(b.column(1), k), centers).argmin(axis=1)       # first of equal ones
            count += np.bincount(own, minlength=k)
            for j in range(k):
                total[j] += x[own == j].sum(axis=0)
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), _lists(total[met])],
                                             ["cluster", "members", "total"])
    return run


def _assigned(centers: np.ndarray):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), centers.shape[1])
            d = distances(x, _matrix(b.column(2), len(centers)), centers)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], ["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, starts: list[list[int]], rounds: int = 10) -> tuple[DataFrame, list[list[int]]]:
    """``(id, cluster, distance)`` of every row of ``(id, v)``, and the final centroids.

    ``starts`` are the first centroids, of the vectors' length.  Each round assigns every vector to the
    nearest centroid (equal distances: the smaller number) and replaces each centroid that has members
    by their componentwise floor of the mean; a last assignment follows.  Repeated rows each count.
    Sums of squares are taken to fit a long.
    """
    small_batches(vectors.sparkSession)
    if not starts:
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    centers = np.array(starts, np.int64)
    kind = "id long, v array<long>, dots array<long>"
    state = vectors.select("id", "v").mapInArrow(_first(centers), kind).persist(StorageLevel.MEMORY_AND_DISK)
    for r in range(1, rounds + 1):
        parts = state.select("v", "dots").mapInArrow(_sums(centers), "cluster int, members long, total array<long>")
        totals = (parts.select("cluster", "members", F.posexplode("total").alias("at", "part"))
                  .groupBy("cluster", "at").agg(F.sum("members").alias("members"), F.sum("part").alias("total")).collect())
        after = centers.copy()
        for row in totals:
            after[row["cluster"], row["at"]] = row["total"] // row["members"]
        last, change, centers = state, after - centers, after
        if change.any():
            state = state.mapInArrow(_advance(change), kind)
            state = save(state, "centroid_products") if r % CUT_ROUNDS == 0 else state
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            if r % CUT_ROUNDS == 0:
                last.unpersist()
            else:
                state.count()             # made before what it is made from is let go
                last.unpersist()
    found = save(state.mapInArrow(_assigned(centers), "id long, cluster int, distance long"), "centroid_clusters")
    state.unpersist()
    return found, centers.tolist()


def hashed_starts(vectors: DataFrame, count: int = 8, prefix: str = "3:") -> list[list[int]]:
    """The ``count`` vectors with the smallest hex SHA-256 of prefix and decimal id; null ids come last."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(name.asc_nulls_last(), "v").limit(count).select("v").collect()]


def digest(embeddings: DataFrame) -> DataFrame:
    """Contract form: eight clusters of 64-component vectors after ten rounds, with inertia and centroid hashes."""
    vectors = save(whole_vectors(embeddings, "vec_id", "embedding", 64), "centroid_vectors")
    found, centers = cluster(vectors, hashed_starts(vectors), rounds=10)
    spark = embeddings.sparkSession
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()      # a row a cluster
    inertia = sum(r["cluster_inertia"] for r in sums)
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, ",".join(map(str, centers[r["cluster"]])))
                                   for r in sums], "cluster int, cluster_inertia long, inertia long, text string")
    return found.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2("text", 256).alias("centroid_sha256"))
