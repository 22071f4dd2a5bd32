"""Fuzzy line deduplication: MinHash candidates, exact Jaccard, one line kept per component.

A line is compared in lower case with single spaces.  Equal lines are one node from the start.
Signatures of 48 minima over eight-character shingles are cut into 12 bands of four: lines of
Jaccard similarity 0.8 share a band with probability 0.998, more similar ones with more.  Lines
that share a band are compared by the exact Jaccard similarity of their shingle sets, and
verified links are closed by distributed union-find.  The first line (by document, then line
number) of each component stays; every other occurrence is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, free_name, keyed, partitions, save, text_of

SHINGLE = 8
BANDS, ROWS = 12, 4
SIMILARITY = 0.8
GROUP = 1024               # members of a cell that are compared with one another
HOT = 64                   # lines of a band in one task from which the band is spread
FLUSH = 1 << 22            # band entries a task holds before it sends them
CHUNK = 1 << 16            # characters whose shingles are hashed at a time

_rng = np.random.RandomState(20_011)
SLOPES = (_rng.randint(0, 1 << 31, BANDS * ROWS, dtype=np.int64) * 2 + 1).astype(np.uint32)
SHIFTS = _rng.randint(0, 1 << 32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)
#: Multipliers that join two halves of a shingle, for halves of 1, 2 and 4 characters.
BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str) -> set[str]:
    """Distinct shingles; a line shorter than one is its own shingle."""
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _sorted_shingles(line: str) -> np.ndarray | None:
    """Distinct shingles as the numbers their eight bytes make, ascending; None if the line is
    shorter than one or has characters that are no single byte in Latin-1."""
    if len(line) < SHINGLE:
        return None
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    found = np.concatenate([np.frombuffer(raw, "<u8", (len(raw) - first) // SHINGLE, first)
                            for first in range(min(SHINGLE, len(raw) - SHINGLE + 1))])
    found.sort()
    new = np.empty(len(found), bool)
    new[0] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


class _Compared:
    """A line as ``similar`` wants it: sorted numbers where they are exact, a set otherwise."""

    __slots__ = ("text", "numbers", "size", "_set")

    def __init__(self, text: str):
        self.text, self.numbers, self._set = text, _sorted_shingles(text), None
        self.size = len(self.strings() if self.numbers is None else self.numbers)

    def strings(self) -> set[str]:
        if self._set is None:
            self._set = shingles(self.text)
        return self._set


def similar(a: _Compared, b: _Compared) -> bool:
    """Whether the exact Jaccard similarity of the shingle sets is SIMILARITY or more."""
    small, large = sorted((a.size, b.size))
    if small < SIMILARITY * large:
        return False
    if a.numbers is not None and b.numbers is not None:
        both = np.concatenate((a.numbers, b.numbers))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
    else:
        common = len(a.strings() & b.strings())
    return common >= SIMILARITY * (small + large - common)


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, 48) minima of the shingle hashes of non-empty normal lines."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    at = 0
    while at < len(lines):
        size, upto = 0, at
        while upto < len(lines) and (size < CHUNK or upto == at):
            size += max(len(lines[upto]), SHINGLE)
            upto += 1
        part = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines[at:upto]]
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h, width = code, 1
        for base in BASES:              # hash of 2, 4, 8 characters
            h = h[:-width] * base + h[width:]
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(x) for x in part])
        ends = np.cumsum(sizes)
        cuts = np.empty(2 * len(part), np.int64)
        cuts[0::2], cuts[1::2] = ends - sizes, ends - SHINGLE + 1
        cuts = cuts[:-1] if cuts[-1] >= len(h) else cuts
        v = np.empty_like(h)
        for j in range(BANDS * ROWS):
            np.multiply(h, SLOPES[j], out=v)
            np.add(v, SHIFTS[j], out=v)
            out[at:upto, j] = np.minimum.reduceat(v, cuts)[::2]
        at = upto
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, 12) 64-bit keys, different for each band."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def occurrences(rows: DataFrame) -> DataFrame:
    """``(k1, k2, key, line)``: a 128-bit content key for each non-blank line of ``(key, text)``."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                digests, keys, numbers = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, line in enumerate(text.split("\n")):
                        line = normal(line)
                        if line:
                            digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                            keys.append(key)
                            numbers.append(i)
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(keys, pa.int64()),
                     pa.array(numbers, pa.int32())], ["k1", "k2", "key", "line"])

    return rows.mapInArrow(run, "k1 long, k2 long, key long, line int")


def _distinct_lines(batches, size):
    """Lists of at most ``size`` normal lines, each line once for the task as far as it remembers."""
    known: set[bytes] = set()
    lines, digests = [], []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for line in text.split("\n"):
                line = normal(line)
                if line:
                    d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    if d not in known:
                        known.add(d)
                        lines.append(line)
                        digests.append(d)
            if len(lines) >= size:
                yield lines, digests
                lines, digests = [], []
                if len(known) > 500_000:
                    known.clear()
    if lines:
        yield lines, digests


def band_members(rows: DataFrame) -> DataFrame:
    """``(band, k1)`` of the bands that hold two lines or more.

    Entries travel as blocks of arrays, one for each task and target.  A band with many lines
    in one task is known to be shared: its entries are spread over all targets and need no
    further check there, and one of them also goes to the band's own target as a witness.
    """
    n = partitions(rows.sparkSession)

    def send(batches):
        def blocks(keys, lines):
            order = np.lexsort((lines, keys))
            keys, lines = keys[order], lines[order]
            first = np.r_[True, keys[1:] != keys[:-1]]
            size = np.diff(np.r_[np.flatnonzero(first), len(keys)])
            hot = np.repeat(size >= HOT, size)
            witness = hot & first
            spread = np.r_[hot, np.zeros(witness.sum(), bool)]
            keys, lines = np.r_[keys, keys[witness]], np.r_[lines, lines[witness]]
            to = np.where(spread, lines % np.uint64(n), keys % np.uint64(n)).astype(np.int64)
            order = np.lexsort((spread, to))
            keys, lines, to, spread = keys[order], lines[order], to[order], spread[order]
            ends = np.flatnonzero(np.r_[(to[1:] != to[:-1]) | (spread[1:] != spread[:-1]), True]) + 1
            at = 0
            for end in ends:
                yield (int(to[at]), bool(spread[at]), keys[at:end].tobytes() + lines[at:end].tobytes())
                at = end

        held_keys, held_lines, held = [], [], 0

        def flush():
            out = list(blocks(np.concatenate(held_keys), np.concatenate(held_lines)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]),
                 pa.array([x[2] for x in out], pa.binary())], ["target", "shared", "entries"])

        for lines, digests in _distinct_lines(batches, 4000):
            keys = band_keys(signatures(lines))
            held_keys.append(keys.reshape(-1))
            held_lines.append(np.repeat(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, 0], BANDS))
            held += keys.size
            if held >= FLUSH:
                yield from flush()
                held_keys, held_lines, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches):
        own, shared = [], []
        for batch in batches:
            for flag, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                pair = np.frombuffer(raw.as_buffer(), "<u8").reshape(2, -1)
                (shared if flag else own).append(pair)
        found = [np.concatenate(shared, axis=1)] if shared else []
        if own:
            keys, lines = np.concatenate(own, axis=1)
            order = np.lexsort((lines, keys))
            keys, lines = keys[order], lines[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])]
            keys, lines = keys[new], lines[new]
            same = keys[1:] == keys[:-1]
            many = np.r_[same, False] | np.r_[False, same]
            found.append(np.stack([keys[many], lines[many]]))
        if found:
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            for lo in range(0, both.shape[1], 100_000):
                part = np.ascontiguousarray(both[:, lo:lo + 100_000]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["band", "k1"])

    sent = rows.select("text").mapInArrow(send, "target int, shared boolean, entries binary")
    return sent.repartitionById(n, "target").mapInArrow(meet, "band long, k1 long")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, k1, k2, text)`` of the lines whose k1 is wanted, each line once."""
    def run(batches):
        for lines, digests in _distinct_lines(batches, 4000):
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(lines)],
                                             ["k1", "k2", "text"])

    lines = rows.select("text").mapInArrow(run, "k1 long, k2 long, text string")
    some = lines.join(wanted, "k1", "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return save(some.withColumn("node", F.monotonically_increasing_id()), "line_texts")


def _verify(batches):
    """Links within each (band, cell): pairs of similarity SIMILARITY, enough to connect all such."""
    def solve(nodes, texts):
        lines = [_Compared(t) for t in texts] if len(texts) > 1 else []
        root = list(range(len(nodes)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(nodes)):
            for j in range(i):
                a, b = find(i), find(j)
                if a == b:
                    continue
                if similar(lines[i], lines[j]):
                    root[a] = b
                    yield nodes[i], nodes[j]

    last, nodes, texts, out = None, [], [], []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                           pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for band, low, high, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (band, low, high) != last:
                out += solve(nodes, texts)
                last, nodes, texts = (band, low, high), [], []
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
            nodes.append(node)
            texts.append(text)
    out += solve(nodes, texts)
    if out:
        yield batch_of(out)


def similar_lines(rows: DataFrame) -> DataFrame:
    """``(k1, k2, component)`` of the lines that have a similar, not equal, partner."""
    members = save(band_members(rows).distinct(), "line_bands")
    # bands with the same lines are one group; a group with many lines is cut into chunks, and every
    # pair of chunks meets in one cell, so any two lines of a group are compared and none is capped
    groups = members.groupBy("band").agg(F.count("*").alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi"),
                                         F.sum(F.xxhash64("k1").cast("decimal(38,0)")).alias("h"))
    groups = save(groups.where("n > 1").groupBy("n", "lo", "hi", "h").agg(F.min("band").alias("band"))
                  .select("band", F.ceil(F.col("n") / F.lit(GROUP // 2)).cast("int").alias("chunks")), "line_groups")
    chosen = members.join(groups, "band")
    cells = chosen.withColumn("chunk", F.when(F.col("chunks") <= 2, F.lit(0))
                              .otherwise(F.pmod(F.xxhash64("k1"), F.col("chunks")).cast("int")))
    cells = cells.select("band", "k1", "chunk", F.explode(
        F.when(F.col("chunks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("other"), "chunks")
    cells = cells.where("chunks <= 2 OR chunk <> other")
    cells = cells.select("band", "k1", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    texts = _texts(rows, save(members.select("k1").distinct(), "line_wanted"))
    joined = cells.join(texts.select("k1", "node", "text"), "k1").select("band", "low", "high", "node", "text")
    n = partitions(rows.sparkSession)
    links = (joined.repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high", "node")
             .mapInArrow(_verify, "a long, b long"))
    comps = connected_components(links)
    return save(comps.join(texts.select("node", "k1", "k2"), "node").select("k1", "k2", "component"), "line_components")


def duplicate_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``(key, text)``: ``(key, line, keep_key, keep_line)`` of every line to drop with the line
    that stands for it, and all occurrences ``(k1, k2, key, line)``."""
    seen = save(occurrences(rows), "line_occurrences")
    firsts = save(seen.groupBy("k1", "k2").agg(F.min(F.struct("key", "line")).alias("first"), F.count("*").alias("n")),
                  "line_firsts")
    comps = similar_lines(rows)
    in_comp = save(firsts.join(comps, ["k1", "k2"]).select("k1", "k2", "component", "first"), "line_members")
    lows = save(in_comp.groupBy("component").agg(F.min("first").alias("keep")), "line_lows")
    fuzzy = in_comp.join(lows, "component").select("k1", "k2", "keep")
    exact = firsts.where("n > 1").join(comps, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("first").alias("keep"))
    kept = save(fuzzy.union(exact), "line_kept")
    gone = (seen.join(kept, ["k1", "k2"]).where("key <> keep.key OR line <> keep.line")
            .select("key", "line", F.col("keep.key").alias("keep_key"), F.col("keep.line").alias("keep_line")))
    return gone, seen


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_lines, n_dropped, dropped)``: one row per document; dropped holds, by line
    number, line, keep_id and keep_line of every dropped line.  n_lines counts non-blank lines."""
    rows, key = keyed(docs, id_col, text_col)
    named = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    gone, seen = duplicate_lines(named.select("key", "text"))
    if "row_number" in key:                 # numbered rows: look the id of the kept line up
        gone = gone.join(named.select(F.col("key").alias("keep_key"), F.col("id").alias("keep_id")), "keep_key")
    else:
        gone = gone.withColumn("keep_id", F.col("keep_key"))
    dropped = gone.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "keep_id", "keep_line"))).alias("dropped"))
    counts = seen.groupBy("key").agg(F.count("*").alias("n_lines")).join(dropped, "key", "left")
    return named.select("key", "id").join(counts, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "dropped")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t, g):
        if g is None:
            return t
        g = set(g)
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in g])
    return pd.Series([cut(t, g) for t, g in zip(text, gone)])


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; all rows and columns stay.

    Blank lines are never dropped.  Null text: stays null.  Empty texts have no line.  Null
    and repeated ids: rows are told apart by their order (id, null last, then text).
    """
    rows, key = keyed(docs, id_col, text_col)
    named = rows.select(F.col(key).alias("key"), text_of(text_col).alias("text"))
    gone, _ = duplicate_lines(named)
    k, g = free_name(rows, "__of"), free_name(rows, "__gone")
    per = save(gone.groupBy(F.col("key").alias(k)).agg(F.collect_set("line").alias(g)), "line_gone")
    joined = rows.join(per, F.col(key) == F.col(k), "left")
    new = F.when(F.col(g).isNull(), F.col(f"`{text_col}`")).otherwise(_without(f"`{text_col}`", g))
    return joined.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
