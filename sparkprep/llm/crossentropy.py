"""Cross-entropy difference between a target and a background model of the same kind.

Both models are character four-gram models (a character is a UTF-16 code unit) with Witten-Bell
interpolation down to one uniform distribution over the shared vocabulary: every unit of the
corpus.  The background is counted over all documents, the target over the documents chosen as
targets.  The loss of a token under each model is minus the natural logarithm of its
probability; a document's score is the mean over its tokens of target loss minus background loss.

All n-grams are counted, none is cut off.  They grow with the corpus far slower than its text, so
the finished table is sent to the tasks in blocks of bounded size, and documents are scored
against each block in turn; a table that fits one block is the usual case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, save, text_of

ORDER = 4
UNIT_BITS = 16
BLOCK_GRAMS = 2_000_000     # n-grams of the table sent to the tasks at a time (40 MB)
FLUSH = 1 << 22             # n-grams a task holds before it counts them


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of every token of all texts, tokens of each text).

    An n-gram is four units in one number, the predicted token last; three zero units stand
    before each text.
    """
    pad = np.zeros(ORDER - 1, np.uint16)
    parts, sizes = [], []
    for t in texts:
        units = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2")
        parts += [pad, units]
        sizes.append(len(units))
    all_units = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    n = np.array(sizes, np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    key = np.zeros(len(all_units) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = key << np.uint64(UNIT_BITS) | all_units[i:len(all_units) - ORDER + 1 + i]
    firsts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    at = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return key[at], n


def count(rows: DataFrame) -> DataFrame:
    """``(gram, background, target)`` counts of ``(text, is_target)``."""
    def run(batches):
        held: list[np.ndarray] = []
        chosen: list[np.ndarray] = []
        size = 0

        def flush():
            every, n = np.unique(np.concatenate(held), return_counts=True)
            target = np.zeros(len(every), np.int64)
            if chosen:
                some, m = np.unique(np.concatenate(chosen), return_counts=True)
                target[np.searchsorted(every, some)] = m
            return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n), pa.array(target)],
                                              ["gram", "background", "target"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                key, n = grams(part.column(0).to_pylist())
                held.append(key)
                flags = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), n)
                if flags.any():
                    chosen.append(key[flags])
                size += len(key)
                if size >= FLUSH:
                    yield flush()
                    held, chosen, size = [], [], 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "gram long, background long, target long").groupBy("gram").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target"))


def _last(gram: Column, units: int) -> Column:
    """The last ``units`` units of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << UNIT_BITS * units) - 1)) if units < ORDER else gram


def losses(counts: DataFrame) -> DataFrame:
    """``(gram, background, target)`` losses of the last unit after the others, for every n-gram."""
    both = ("background", "target")
    vocabulary = counts.select(_last(F.col("gram"), 1).alias("unit")).distinct().count()
    known: DataFrame | None = None
    for k in range(1, ORDER + 1):
        table = counts.groupBy(_last(F.col("gram"), k).alias("g")).agg(*[F.sum(c).alias(c) for c in both])
        if k < ORDER:
            table = save(table, "ngrams")
        context = F.shiftrightunsigned("g", UNIT_BITS).alias("h")
        totals = table.groupBy(context).agg(*[F.sum(c).alias(f"n_{c}") for c in both],
                                            *[F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}") for c in both])
        joined = table.withColumn("h", F.shiftrightunsigned("g", UNIT_BITS)).join(save(totals, "contexts"), "h")
        if known is None:
            joined = joined.select("*", *[F.lit(1.0 / max(1, vocabulary)).alias(f"p_{c}") for c in both])
        else:
            joined = joined.withColumn("lower", _last(F.col("g"), k - 1)).join(
                known.withColumnRenamed("g", "lower"), "lower")

        def mixed(c: str) -> Column:
            seen = F.col(f"n_{c}") + F.col(f"t_{c}")
            return F.when(seen > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / seen).otherwise(F.col(f"p_{c}"))

        known = save(joined.select("g", *[mixed(c).alias(f"p_{c}") for c in both]), "probabilities")
    return known.select(F.col("g").alias("gram"), *[(-F.log(f"p_{c}")).alias(c) for c in both])


class Lookup:
    """Row of an n-gram in a sorted list, or -1, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = keys
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]              # of several on one slot the last stays
            lost = self.rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys ^ keys >> np.uint64(31)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        row = self.rows[slot]
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            row[open_] = self.rows[slot[open_]]
            open_ = open_[(row[open_] >= 0) & (self.keys[row[open_]] != keys[open_])]
        return row


def _score(shared):
    def run(batches):
        keys, background, target = shared.value
        table = Lookup(keys)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                key, n = grams(part.column(1).to_pylist())
                row = table.find(key)
                here = row >= 0
                doc = np.repeat(np.arange(len(n)), n)[here]
                sums = [np.bincount(doc, weights=w[row[here]], minlength=len(n)) for w in (background, target)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1])],
                    ["key", "n_tokens", "background", "target"])

    return run


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_tokens, loss_target, loss_background, xent_diff)``: one row per document.

    ``targets`` holds the ids (column ``id_col``) of the target documents, repeats allowed.  Null
    texts count as empty; an empty text has no token and null losses.  Rows with a null id are in
    the background only; rows with equal ids keep one result each.  Without any target document
    the target model is uniform.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows, key = keyed(docs, id_col, text_col)
    named = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    chosen = save(targets.select(F.col(f"`{id_col}`").alias("of")).where("of IS NOT NULL").distinct(), "targets")
    flagged = named.select("id", "text").join(chosen, F.col("id") == F.col("of"), "left").select(
        "text", F.col("of").isNotNull().alias("is_target"))
    table = save(losses(save(count(flagged), "ngram_counts")), "losses")
    size = table.count()
    blocks = max(1, -(-size // BLOCK_GRAMS))
    parts = []
    for b in range(blocks):
        block = table.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b).toPandas()
        order = np.argsort(block["gram"].to_numpy().view(np.uint64))
        arrays = (block["gram"].to_numpy().view(np.uint64)[order], block["background"].to_numpy()[order],
                  block["target"].to_numpy()[order])
        parts.append(named.select("key", "text").mapInArrow(
            _score(spark.sparkContext.broadcast(arrays)), "key long, n_tokens long, background double, target double"))
    found = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            found = found.union(p)
        found = found.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.sum("background").alias("background"),
                                         F.sum("target").alias("target"))
    if "row_number" in key:
        found = found.join(named.select("key", "id"), "key")
    else:
        found = found.withColumn("id", F.col("key").cast(docs.schema[id_col].dataType))
    n = F.nullif(F.col("n_tokens"), F.lit(0))
    return found.select(F.col("id").alias(id_col), "n_tokens", (F.col("target") / n).alias("loss_target"),
                        (F.col("background") / n).alias("loss_background"),
                        ((F.col("target") - F.col("background")) / n).alias("xent_diff"))
