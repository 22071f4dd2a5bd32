"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its rank (0: the most frequent id of the corpus), and a rank takes one
to four whole bytes.  The byte counts of four ranks stand in one control byte; control bytes and
data bytes are kept in separate streams, so a reader finds all lengths by one table lookup per
control byte and gathers the data with array operations.

A file set is a folder of Parquet files, the container of the blocks (any store that Spark
writes to will do).  Files hold shards in ascending key order; a row is one block of whole
documents: shard, start (ids before it in the shard), n_ids, keys, ids (of the documents),
lengths, control, data.  The rank table, vocabulary entries long, stands in ``ranks`` beside it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, save, scratch_path, text_rows
from .tokens import id_type, token_rows

BLOCK_IDS = 1 << 16        # a block is closed once it has this many ids
SHARD_IDS = 1 << 24        # ids of a shard, about

#: Byte counts of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    v = np.ascontiguousarray(ranks, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[:len(v)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of the two streams."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    values = raw[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        more = np.flatnonzero(lengths > byte)
        if not len(more):
            break
        values[more] |= raw[starts[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def _squeeze(width: int, vocabulary: int):
    """Compress ids for the scratch table and the shuffle (byte planes, then zstd); a last row of each
    task, with n = -1, holds how often it met every id."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        total, last = np.zeros(vocabulary, np.int64), None
        for b in batches:
            packed = []
            for x in b.column(3):
                raw = np.frombuffer(x.as_buffer(), np.uint8)
                packed.append(press.compress(raw.reshape(-1, width).T.tobytes()))
            all_ids = np.frombuffer(b"".join([x.as_buffer().to_pybytes() for x in b.column(3)]), f"<u{width}")
            total += np.bincount(all_ids, minlength=vocabulary)
            last = b
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())],
                                             ["key", "id", "n", "ids"])
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.nulls(1, last.column(1).type), pa.array([-1], pa.int64()),
                 pa.array([press.compress(total.tobytes())], pa.binary())], ["key", "id", "n", "ids"])

    return run


def _loosen(packed: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def frequency_ranks(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """rank -> id over all documents: most frequent first, ties by id.  ``counts`` are the tasks'
    own; at most one row for each id of the vocabulary reaches the driver."""
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(zstandard.decompress(x), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    counted = counts.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    count = np.zeros(vocabulary, np.int64)
    for r in counted.collect():
        count[r["token"]] = r["n"]
    return np.lexsort((np.arange(vocabulary), -count)).astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int | None,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts (null: empty) and write the file set in ascending id order.

    Null ids come last; rows with equal ids stand in the order of their texts, and a text with
    no token is kept as a document of length 0 or of the end id alone.  Other columns are not read.
    """
    spark = docs.sparkSession
    width = np.dtype(id_type(vocabulary)).itemsize
    saved = save(token_rows(text_rows(docs, id_col, text_col), tokenizer, end_id, _squeeze(width, vocabulary)), "tokens")
    tokens = saved.where("n >= 0")
    ranking = frequency_ranks(saved.where("n < 0"), vocabulary)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[ranking] = np.arange(vocabulary, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)          # vocabulary x 4 bytes
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(min(partitions(spark), 1 + total // BLOCK_IDS), -(-total // SHARD_IDS), 1)
    ordered = tokens.repartitionByRange(shards, "key").sortWithinPartitions("key")
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        shard, start = TaskContext.get().partitionId(), 0
        keys, ids, arrays, held, id_kind = [], [], [], 0, None

        def block():
            control, data = encode(shared.value[np.concatenate(arrays)] if arrays else np.zeros(0, np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([start]), pa.array([held]), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([ids], pa.list_(id_kind)), pa.array([[len(a) for a in arrays]], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "start", "n_ids", "keys", "ids", "lengths", "control", "data"])

        for b in batches:
            id_kind = b.column(1).type
            for key, ident, n, x in zip(*(c.to_pylist() for c in b.columns)):
                keys.append(key)
                ids.append(ident)
                arrays.append(_loosen(x, n, width))
                held += n
                if held >= BLOCK_IDS:
                    yield block()
                    start += held
                    keys, ids, arrays, held = [], [], [], 0
        if keys:
            yield block()

    blocks = ordered.mapInArrow(run, "shard long, start long, n_ids long, keys array<long>, "
                                     f"ids array<{kind}>, lengths array<long>, control binary, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(ranking)], "rank long, token long").coalesce(1).write.parquet(
        f"{path}/ranks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32, ids binary)`` of a file set, one row per document.

    start counts the ids of all documents before it in the set; ids are little-endian unsigned
    32-bit.  A shard's total is one row; those totals, a few bytes for each file, are summed on
    the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").collect()   # one row for each id of the vocabulary
    ranking = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        ranking[r["rank"]] = r["token"]
    before, sofar = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        before[r["shard"]] = sofar
        sofar += r["n"]
    shared = spark.sparkContext.broadcast((ranking, before))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        ranking, before = shared.value
        for b in batches:
            for i in range(b.num_rows):
                shard, start, n, _, _, lengths, control, data = (c[i].as_py() if j != 4 else None
                                                                 for j, c in enumerate(b.columns))
                tokens = ranking[decode(control, data, n)].astype("<u4") if n else np.zeros(0, "<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                firsts = ends - lengths
                parts = [tokens[s:e] for s, e in zip(firsts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(4)[i].values, pa.array(before[shard] + start + firsts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                     pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None) -> DataFrame:
    """Write a file set into the scratch folder and read it back."""
    path = scratch_path(docs.sparkSession, "token_files")
    write(docs, path, tokenizer, vocabulary, end_id)
    return read(docs.sparkSession, path)
