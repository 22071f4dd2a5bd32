"""Near-duplicate documents by SimHash fingerprints.

Method: pigeonhole blocks.  A 64-bit fingerprint is cut into five blocks; two fingerprints
that differ in at most two bits agree on at least three whole blocks, so they share one of
the ten keys made of three blocks.  Rows join on those keys.  Inside a key, a pair within two
bits has a common midpoint that each reaches by flipping at most one of the free bits, so the
members of a key meet at midpoints (at most 27 members can) instead of being paired with one
another; Hamming distance is then verified.  No group can become hot, no pair list is made,
and no link is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, hex64, keyed, save, text_of, text_rows

BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))


def _mask(chosen) -> int:
    bits = sum(((1 << hi) - (1 << lo)) for lo, hi in chosen)
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> bytes:
    """Eight bytes: bit set where over half the shingle hashes have it; no word gives zero."""
    words = text.lower().split()          # bytes: A-Z only, and the six ASCII spaces
    n = words_per_shingle
    if not words:
        return bytes(8)
    if len(words) <= n:
        return xxhash.xxh64_digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e - 1], seed) for s, e in zip(starts, ends[n - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(rows: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(key, id, fp)`` of ``(key, id, text)``; fp is the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            known: dict[bytes, bytes] = {}
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                fp = known.get(text)
                if fp is None:
                    fp = known[text] = fingerprint(text, words_per_shingle, seed)
                out.append(fp)
            longs = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(longs)], ["key", "id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("key", "id", "text").mapInArrow(run, f"key long, id {kind}, fp long")


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(a, b)`` fingerprints within ``max_bits`` (0 to 2), enough of them to connect every linked pair."""
    if not 0 <= max_bits <= 2:
        raise ValueError("five blocks cover at most two differing bits")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = []
    for chosen in combinations(BLOCKS, 3):
        mask = _mask(chosen)
        free = [b for b in range(64) if not any(lo <= b < hi for lo, hi in chosen)]
        flips = [0, *((1 << b) - (1 << 64) if b == 63 else 1 << b for b in free)]
        keys.append((mask, flips))
    ids = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(mask).alias("mask")) for i, (mask, _) in enumerate(keys)])
    entries = (distinct.select("fp", F.explode(ids).alias("t"))
               .select("fp", F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("block")))
    shared = (entries.groupBy("table", "block").agg(F.count("*").alias("n")).where("n > 1").select("table", "block"))
    # written, so that both sides of the join are plain scans whose large partitions Spark can split
    shared = save(shared, "simhash_blocks")
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in f] + [F.lit(0)] * (28 - len(f))) for _, f in keys]),
                         F.col("table") + 1)
    met = (entries.join(shared, ["table", "block"])
           .select("fp", "table", F.explode(F.array_distinct(flips)).alias("flip"))
           .select("fp", "table", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
           .groupBy("table", "mid").agg(F.min("fp").alias("low"), F.collect_set("fp").alias("near"))  # 28 at most
           .where(F.size("near") > 1))
    pairs = met.select(F.col("low").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    if max_bits == 1:
        # members of one midpoint can be two bits apart: keep only what a single flip joins
        pairs = (met.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b"))
                 .where("a < b").distinct())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``(key, <id_col>, fp, component_key, component_id)``: one row per document of ``docs``.

    component_id is the smallest id reachable over links, the row's own included (null ids
    are passed over; a component of null ids only has null).  Null, empty and wordless texts
    have fingerprint zero and link like any other.  Repeated rows stay, one result each, and
    ``key`` tells them apart.  Columns of ``docs`` other than the two named are ignored.
    """
    return _labelled(text_rows(docs, id_col, text_col), words_per_shingle, max_bits, seed).withColumnRenamed("id", id_col)


def _labelled(rows: DataFrame, words_per_shingle: int, max_bits: int, seed: int) -> DataFrame:
    prints = save(fingerprints(rows, words_per_shingle, seed), "simhash_prints")
    distinct = save(prints.groupBy("fp").agg(F.min("key").alias("key"), F.min("id").alias("id")), "simhash_distinct")
    comps = connected_components(links(distinct, max_bits))
    members = distinct.join(comps, F.col("fp") == F.col("node"), "left").select(
        "fp", "key", "id", F.coalesce("component", "fp").alias("component"))
    members = save(members, "simhash_members")
    lows = save(members.groupBy("component").agg(F.min("key").alias("component_key"), F.min("id").alias("component_id")),
                "simhash_lows")
    labels = save(members.join(lows, "component").select("fp", "component_key", "component_id"), "simhash_labels")
    return prints.join(labels, "fp").select("key", "id", "fp", "component_key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words_per_shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """Rows of ``docs``, all columns, with one document of each component: the first by id.

    Null ids come last; of repeated rows with the first id one stays.
    """
    rows, key = keyed(docs, id_col, text_col)
    first = free_name(rows, "__first")
    named = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    firsts = (_labelled(named, words_per_shingle, max_bits, seed).where("key = component_key")
              .select(F.col("component_key").alias(first)))
    return rows.join(firsts, F.col(key) == F.col(first), "left_semi").select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Contract form: doc_id, fingerprint (hex), component_id."""
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
