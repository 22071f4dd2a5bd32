"""Exact top-k by inner product with the Fagin threshold algorithm.

Every candidate block keeps one list per dimension, sorted by component.  A query reads the
lists of its non-zero dimensions from their best end, scores each newly met vector in full
(random access), and stops when the bound of all unread entries, the sum of its weight times
the component at the current depth, cannot reach its k-th score.  Blocks of one task share
each query's k-th score, so later blocks stop sooner; the k best of every task then meet per
query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import save

BLOCK_ROWS = 8192          # vectors whose lists are in memory at a time
QUERY_BLOCK = 4096         # queries broadcast at a time


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``(id, v array<long>)``: floor(scale * x) of every component x as a double.

    Rows with a null id or vector, or with a null or non-finite component, are left out.
    """
    x = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))
    finite = F.forall(F.col(f"`{vector_col}`"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & finite).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v"))


class Block:
    """Vectors of one length with one list per dimension, sorted by component."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray):
        self.vecs, self.ids, self.n = vecs, ids, len(ids)
        self.floats = vecs.astype(np.float64)
        self.most = float(np.abs(vecs).max(initial=0))
        self.lists = np.argsort(vecs, axis=0, kind="stable").astype(np.int32)      # [rank, dimension] -> row

    def scores(self, rows: np.ndarray, q: np.ndarray, exact_float: bool) -> np.ndarray:
        if exact_float:                  # every partial sum below 2**53: doubles are exact
            return (self.floats[rows] @ q).astype(np.int64)
        return self.vecs[rows] @ q


def _best(score: np.ndarray, ids: np.ndarray, k: int):
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def threshold_topk(block: Block, q: np.ndarray, own: int, k: int, score: np.ndarray, found: np.ndarray):
    """Merge a block into a query's (score, id) of the k best so far; ties go to the smaller id.

    Own rows are passed over.  Returns the merged pair and the depth to which the lists were read:
    that at which the bound of what is unread falls below the k-th score, or nothing is left unmet.
    """
    n, ids = block.n, block.ids
    dims = np.flatnonzero(q)
    if not len(dims):                    # every score is zero: the smallest ids win
        rest = np.sort(ids[ids != own])[:k]
        return (*_best(np.concatenate([score, np.zeros(len(rest), np.int64)]), np.concatenate([found, rest]), k), 0)
    weight = q[dims]
    exact = block.most * float(np.abs(weight).max()) * len(dims) < 2.0 ** 52
    wide = q.astype(np.float64) if exact else q
    up, down = dims[weight > 0], dims[weight < 0]      # lists read from their largest and smallest ends
    met = np.zeros(n, bool)
    unmet, depth, step = n, 0, 32
    while unmet:
        upto = min(n, depth + step)
        now = np.zeros(n, bool)
        now[block.lists[n - upto:n - depth, up]] = True
        now[block.lists[depth:upto, down]] = True
        new = np.flatnonzero(now & ~met)
        met[new] = True
        unmet -= len(new)
        new = new[ids[new] != own]
        if len(new):
            got = block.scores(new, wide, exact)
            if len(score) == k:
                keep = got >= score[-1]
                got, new = got[keep], new[keep]
            score, found = _best(np.concatenate([score, got]), np.concatenate([found, ids[new]]), k)
        depth, step = upto, step * 2
        if len(score) == k and unmet:
            bound = (int((block.vecs[block.lists[n - upto, up], up] * q[up]).sum())
                     + int((block.vecs[block.lists[upto - 1, down], down] * q[down]).sum()))
            if bound < score[-1]:        # strictly: an equal score could still win by its id
                break
    return score, found, depth


def _merge(shared, k: int):
    """``shared`` holds (ids, matrix) of each vector length."""
    def run(batches):
        queries = shared.value
        state = {m.shape[1]: [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids] for ids, m in queries}

        def block(table):
            width = np.asarray(pc.list_value_length(table.column(1)))
            ids = table.column(0).to_numpy(zero_copy_only=False)
            for qids, matrix in queries:
                d = matrix.shape[1]
                mine = np.flatnonzero(width == d)
                if not len(mine):
                    continue
                flat = table.column(1).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
                vectors = Block(flat.reshape(len(mine), d), ids[mine])
                for i, qid in enumerate(qids):
                    score, found = state[d][i]
                    state[d][i] = threshold_topk(vectors, matrix[i], qid, k, score, found)[:2]

        held, rows = [], 0
        for batch in batches:            # small Arrow batches meet in a block
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                for at in range(0, rows - rows % BLOCK_ROWS, BLOCK_ROWS):
                    block(whole.slice(at, BLOCK_ROWS))
                held = [whole.slice(rows - rows % BLOCK_ROWS)]
                rows %= BLOCK_ROWS
        if rows:
            block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        for qids, m in queries:
            for qid, (score, found) in zip(qids, state[m.shape[1]]):
                if len(score):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(score), qid)), pa.array(found), pa.array(score)],
                        ["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its k best candidates.

    Both frames are ``(id long, v array<long>)`` as ``integer_vectors`` makes them.  The score
    is the inner product; ties go to the smaller id; candidates with the query's own id are not
    its partners, nor are vectors of another length.  Repeated candidate rows each count;
    of repeated query ids the vector that comes first in array order is asked.  Empty inputs give no rows.  Scores
    are taken to fit a long.  Queries are read in blocks of ``QUERY_BLOCK`` (the size bound of the
    broadcast); each block runs over all candidates.
    """
    spark = candidates.sparkSession
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    if blocks > 1:
        asked = save(asked, "topk_queries")
    schema = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    parts = []
    for b in range(blocks):
        rows = asked.where(F.col("block") == b).orderBy("id").collect()
        by_len: dict[int, list] = {}
        for r in rows:
            by_len.setdefault(len(r["v"]), []).append(r)
        sent = [(np.array([r["id"] for r in g], np.int64), np.array([r["v"] for r in g], np.int64).reshape(len(g), n))
                for n, g in by_len.items()]
        if not sent:
            continue
        shared = spark.sparkContext.broadcast(sent)
        part = ranked(candidates.select("id", "v").mapInArrow(_merge(shared, k), schema))
        if blocks > 1:                   # one block of queries is held at a time
            part = save(part, "topk_block")
            shared.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
