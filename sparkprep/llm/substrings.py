"""Repeated substrings of the corpus by range-partitioned suffixes.

Two equal strings of ``length`` bytes hold the same anchor: the place of the smallest hash of
any 32 bytes inside them (leftmost of equal ones).  So only suffixes that start at anchors need
to meet, about one for every 35 bytes.  They are ordered by their leading 32 bytes (as a hash,
for an even spread), then by their whole surroundings, then by place.  Splitters sampled from
the corpus cut that order into ranges, so that a passage with very many copies spans several
ranges; every range is sorted locally.  Suffixes with equal surroundings meet there: all but the
first are repeats in full.  Suffixes with equal leading bytes but different surroundings, and
those on the border of a range, are compared byte by byte: a multikey quicksort of what follows
and of what precedes the anchor, with the common prefixes of neighbours, tells for each of the
69 strings around an anchor which earlier suffix has it too.  Leading bytes shared by many
different surroundings are made longer until the groups are small, so no group is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, partitions, save, text_of

LENGTH = 100               # bytes of a string that counts as repeated
GRAM = 32                  # leading bytes by which suffixes first meet
REACH = LENGTH - GRAM      # bytes before an anchor that a string around it can cover
SPAN = REACH + LENGTH      # bytes of the surroundings
CELL = 128                 # different surroundings compared in one cell; small, so that groups behave alike at every size
SAMPLE = 200_000           # suffixes that the splitters are taken from, at most
FLUSH = 1 << 16            # suffixes a task holds before it sends them
PIECE = 1 << 20            # bytes of text hashed at a time

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_tables: dict = {}


def anchors(raw: np.ndarray) -> np.ndarray:
    """Places of the anchors of all strings of LENGTH bytes in ``raw`` (uint8), ascending."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64)
    tables = _tables
    if not tables:
        tables["up"], tables["down"] = _powers(PIECE + SPAN + 1)
    found = []
    step = PIECE
    for lo in range(0, len(raw) - LENGTH + 1, step):
        part = raw[lo:lo + step + LENGTH - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * tables["up"][:len(part)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * tables["down"][:len(part) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        # the place in the low bits: the minimum of a window names its leftmost smallest hash
        h = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFF))
        width, need = 1, REACH + 1
        while width * 2 <= need:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < need:
            h = np.minimum(h[:len(h) - (need - width)], h[need - width:])
        at = (h & np.uint64(0xFFFFFF)).astype(np.int64)
        found.append(np.unique(at) + lo)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def _suffixes(key: int, raw: bytes):
    """(lead, around, key, at, after) arrays of one document's anchors."""
    at = anchors(np.frombuffer(raw, np.uint8))
    n = len(raw)
    before = np.minimum(at, REACH)
    after = np.minimum(n - at, LENGTH)
    digest = xxhash.xxh3_64_digest
    lead = b"".join([digest(raw[a:a + GRAM]) for a in at.tolist()])
    around = b"".join([digest(raw[a - b:a + c], b) for a, b, c in zip(at.tolist(), before.tolist(), after.tolist())])
    return (np.frombuffer(lead, ">u8").astype(np.uint64), np.frombuffer(around, ">u8").astype(np.uint64),
            np.full(len(at), key, np.int64), at, after.astype(np.uint8))


def _collect(batches):
    """Chunks of concatenated arrays (lead, around, key, at, after) of at least FLUSH suffixes."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            buffer = text.as_buffer()
            if buffer is None or buffer.size < LENGTH:
                continue
            held.append(_suffixes(key, buffer.to_pybytes()))
            size += len(held[-1][3])
            if size >= FLUSH:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held))


def splitters(rows: DataFrame, n: int) -> list[tuple[int, int, int, int]]:
    """n - 1 cuts of the order (lead, around, key, at), from the suffixes of a bounded sample.

    Only the evenness of the ranges hangs on the sample, not the result.
    """
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    wanted = 500 * n
    share = min(1.0, 40.0 * min(SAMPLE, wanted) / max(1, size["b"] or 1))
    part = rows.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))

    def run(batches):
        for lead, around, key, at, _ in _collect(batches):
            yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(around.view(np.int64)),
                                              pa.array(key), pa.array(at)], ["lead", "around", "key", "at"])

    got = part.mapInArrow(run, "lead long, around long, key long, at long").limit(4 * SAMPLE).toPandas()
    if not len(got):
        return []
    lead, around = got["lead"].to_numpy().view(np.uint64), got["around"].to_numpy().view(np.uint64)
    order = np.lexsort((got["at"], got["key"], around, lead))
    picks = order[(np.arange(1, n) * len(order)) // n]
    return [(int(lead[i]), int(around[i]), int(got["key"][i]), int(got["at"][i])) for i in picks]


def _target(cuts, lead, around, key, at) -> np.ndarray:
    """Number of the range of each suffix: the cuts that are not above it."""
    firsts = np.array([c[0] for c in cuts], np.uint64)
    low, high = np.searchsorted(firsts, lead, "left"), np.searchsorted(firsts, lead, "right")
    to = low.copy()
    for i in np.unique(low[low < high]) if len(cuts) else []:
        j = i                           # the cuts with this lead: compare the rest of the order
        here = np.flatnonzero((low == i) & (high > i))
        while j < len(cuts) and cuts[j][0] == cuts[i][0]:
            _, a, k, p = cuts[j]
            over = (around[here] > np.uint64(a)) | ((around[here] == np.uint64(a)) & (
                (key[here] > k) | ((key[here] == k) & (at[here] >= p))))
            to[here] += over
            j += 1
    return to


def _meet(rows: DataFrame) -> DataFrame:
    """``(open, lead, key, at, before, after)``: suffixes repeated in full (open false), and the
    first of each surroundings whose leading bytes others share (open true)."""
    n = partitions(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(splitters(rows, n))

    def send(batches):
        cuts = shared.value
        for lead, around, key, at, after in _collect(batches):
            to = _target(cuts, lead, around, key, at)
            order = np.lexsort((lead, to))
            ends = np.flatnonzero(np.r_[np.diff(to[order]) != 0, True]) + 1
            targets, blobs, start = [], [], 0
            for end in ends:
                pick = order[start:end]
                targets.append(int(to[pick[0]]))
                blobs.append(b"".join([lead[pick].tobytes(), around[pick].tobytes(), key[pick].tobytes(),
                                       at[pick].tobytes(), after[pick].tobytes()]))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(blobs, pa.binary())],
                                             ["target", "suffixes"])

    def sort(batches):
        parts = []
        for batch in batches:
            for blob in batch.column(1):
                raw = np.frombuffer(blob.as_buffer(), np.uint8)
                m = len(raw) // 33
                words = raw[:32 * m].view(np.uint64).reshape(4, m)
                parts.append((words, raw[32 * m:]))
        if not parts:
            return
        words = np.concatenate([p[0] for p in parts], axis=1)
        after = np.concatenate([p[1] for p in parts]).astype(np.int64)
        lead, around, key, at = words[0], words[1], words[2].view(np.int64), words[3].view(np.int64)
        order = np.lexsort((at, key, around, lead))
        lead, around, key, at, after = lead[order], around[order], key[order], at[order], after[order]
        new_lead = np.r_[True, lead[1:] != lead[:-1]]
        first = new_lead | np.r_[True, around[1:] != around[:-1]]
        group = np.cumsum(new_lead) - 1
        several = np.bincount(group, weights=first)[group] > 1
        border = (lead == lead[0]) | (lead == lead[-1])
        is_open = first & (several | border)
        for mask, flag in ((~first, False), (is_open, True)):
            where = np.flatnonzero(mask)
            for lo in range(0, len(where), 20_000):
                pick = where[lo:lo + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pick), flag)), pa.array(lead[pick].view(np.int64)), pa.array(key[pick]),
                     pa.array(at[pick]), pa.array(np.minimum(at[pick], REACH).astype(np.int32)),
                     pa.array(after[pick].astype(np.int32))], ["open", "lead", "key", "at", "before", "after"])

    sent = rows.mapInArrow(send, "target int, suffixes binary")
    return save(sent.repartitionById(n, "target").mapInArrow(
        sort, "open boolean, lead long, key long, at long, before int, after int"), "suffixes")


def multikey_sort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (big-endian 64-bit words of strings) within ``group``: by the
    first word, then ties alone by the next, and so on."""
    order = np.lexsort((words[:, 0], group))
    rank = np.cumsum(np.r_[False, (np.diff(group[order]) != 0) | (np.diff(words[order, 0]) != 0)])
    for w in range(1, words.shape[1]):
        tied = np.r_[False, rank[1:] == rank[:-1]]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        rows, old = order[places], rank[places]
        inner = np.lexsort((words[rows, w], old))
        order[places] = rows[inner]
        word = words[order, w]
        same = (rank[1:] == rank[:-1]) & (word[1:] == word[:-1])
        rank = np.cumsum(np.r_[False, ~same])
    return order


def _classes(strings: np.ndarray, group: np.ndarray):
    """order, and for neighbours in it the length of their common prefix (-1 across groups)."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    order = multikey_sort(padded.view(">u8").astype(np.uint64), group)
    common = np.empty(n, np.int64)
    common[:1] = -1
    for lo in range(1, n, 65_536):
        b = strings[order[lo:lo + 65_536]]
        differs = strings[order[lo - 1:lo - 1 + len(b)]] != b
        common[lo:lo + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeated_windows(context: np.ndarray, group: np.ndarray, before: np.ndarray, after: np.ndarray,
                     low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(rows, 69) flags: string o of the row (bytes o to o + LENGTH of its context, the anchor at
    byte REACH) also stands, at the same o, in an earlier row of its group.

    Rows come in the order of their places.  Only strings from ``low`` to ``high`` of a row take
    part, and only where the row's text reaches.
    """
    n = len(group)
    flags = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return flags
    right, right_common = _classes(np.ascontiguousarray(context[:, REACH:]), group)
    left, left_common = _classes(np.ascontiguousarray(context[:, REACH - 1::-1]), group)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        rows = np.flatnonzero((low <= o) & (o <= high) & (REACH - before <= o) & (o + LENGTH <= REACH + after))
        if len(rows) < 2:
            continue
        right_class[right] = np.cumsum(right_common < o + LENGTH - REACH)
        left_class[left] = np.cumsum(left_common < REACH - o)
        both = left_class[rows] * np.int64(n + 1) + right_class[rows]
        order = np.argsort(both, kind="stable")
        flags[rows[order[1:]], o] = both[order[1:]] == both[order[:-1]]
    return flags


def _compare(batches):
    """Repeated intervals (key, start, end) of rows sorted by cell; a cell fits in memory."""
    held, last = [], None

    def solve(rows):
        if not rows:
            return None
        cells = np.array([r[0] for r in rows], np.int64)
        keys, ats = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        order = np.lexsort((ats, keys))
        rows = [rows[i] for i in order]
        cells, keys, ats = cells[order], keys[order], ats[order]
        before = np.array([r[3] for r in rows], np.int64)
        after = np.array([r[4] for r in rows], np.int64)
        low, high = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
        context = np.frombuffer(b"".join([bytes(REACH - r[3]) + r[7] + bytes(LENGTH - r[4]) for r in rows]),
                                np.uint8).reshape(len(rows), SPAN)
        flags = repeated_windows(context, np.unique(cells, return_inverse=True)[1], before, after, low, high)
        padded = np.zeros((len(rows), REACH + 3), np.int8)
        padded[:, 1:-1] = flags
        edge = np.diff(padded, axis=1)
        i, starts = np.nonzero(edge == 1)
        _, ends = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[i]), pa.array(ats[i] - REACH + starts), pa.array(ats[i] - REACH + ends - 1 + LENGTH)],
            ["key", "start", "end"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and len(held) >= 5_000:
                yield solve(held)
                held = []
            last = row[0]
            held.append(row)
    out = solve(held)
    if out is not None:
        yield out


_NAMES = ["lead", "key", "at", "before", "after", "low", "high", "context"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
_CONTEXT = "lead long, key long, at long, before int, after int, low int, high int, context binary"


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def _contexts(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Surroundings of open suffixes, cut out of the texts; strings 0 to REACH take part."""
    per_doc = open_rows.groupBy(F.col("key").alias("of")).agg(
        F.collect_list(F.struct("lead", "at", "before", "after")).alias("suffixes"))
    joined = texts.join(per_doc, F.col("key") == F.col("of")).select("key", "packed", "suffixes")

    def run(batches):
        for batch in batches:
            out = []
            for key, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = zstandard.decompress(packed.as_buffer())
                for lead, at, before, after in zip(*(f.to_pylist() for f in found.values.flatten())):
                    out.append((lead, key, at, before, after, 0, REACH, raw[at - before:at + after]))
                if len(out) > 5_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return joined.mapInArrow(run, _CONTEXT)


def _longer(batches):
    """Each row twice, with half of its strings, grouped by all bytes that the half has in common.

    Strings low to high share bytes high to low + LENGTH of the context; a row in whose text one
    of them stands has those bytes.  Equal strings stay in one group, so no match is lost.
    """
    for batch in batches:
        out = []
        for lead, key, at, before, after, low, high, context in zip(*(c.to_pylist() for c in batch.columns)):
            half, shift = (low + high) // 2, REACH - before
            for lo, hi in ((low, half), (half + 1, high)):
                if max(lo, REACH - before) <= min(hi, REACH + after - LENGTH):
                    core = context[hi - shift:lo + LENGTH - shift]
                    new = xxhash.xxh3_64_intdigest(core, (lead ^ (lo << 8 | hi)) & (1 << 64) - 1)
                    out.append((new - (1 << 63), key, at, before, after, lo, hi, context))
        if out:
            yield _batch(out)


def _pack(rows: DataFrame) -> DataFrame:
    """``(key, packed)``: the texts as zstd frames, to keep shuffles small."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([press.compress(t.as_buffer()) for t in part.column(1)], pa.binary())],
                    ["key", "packed"])

    return rows.mapInArrow(run, "key long, packed binary")


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """``(key, start, end)`` byte intervals of ``(key, text binary)`` whose union is every byte covered
    by a string of LENGTH bytes that also starts earlier (smaller key, or same key and earlier)."""
    n = partitions(rows.sparkSession)
    suffixes = _meet(rows)
    full = suffixes.where("NOT open").select(
        "key", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    opened = suffixes.where("open").drop("open")
    sizes = save(opened.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1"), "suffix_groups")
    todo = save(_contexts(opened.join(sizes.select("lead"), "lead", "left_semi"), _pack(rows)), "suffix_contexts")
    parts = [full]
    while True:
        cool = todo.join(sizes.where(f"n <= {CELL}").select("lead"), "lead", "left_semi").select(_NAMES)
        parts.append(save(cool.repartition(n, "lead").sortWithinPartitions("lead")
                          .mapInArrow(_compare, "key long, start long, end long"), "suffix_repeats"))
        hot = sizes.where(f"n > {CELL}")
        if hot.isEmpty():
            break
        hot_rows = todo.join(hot.select("lead"), "lead", "left_semi").select(_NAMES)
        # groups of one string each need no comparing: all rows but the first repeat it
        single = hot_rows.where("low = high").select("lead", "key", "at", "low")
        firsts = save(single.groupBy("lead").agg(F.min(F.struct("key", "at")).alias("first")), "suffix_firsts")
        parts.append(single.join(firsts, "lead").where("key <> first.key OR at <> first.at").select(
            "key", (F.col("at") - REACH + F.col("low")).alias("start"),
            (F.col("at") - REACH + F.col("low") + LENGTH).alias("end")))
        todo = save(hot_rows.where("low < high").mapInArrow(_longer, _CONTEXT), "suffix_contexts")
        sizes = save(todo.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1"), "suffix_groups")
        if sizes.isEmpty():
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _kept(raw: bytes, starts, ends) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what is left."""
    if not len(starts):
        return 0, 0, raw
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    fresh = np.r_[True, s[1:] > e[:-1]]     # touching runs are one
    s, e = s[fresh], e[np.r_[np.flatnonzero(fresh)[1:] - 1, len(e) - 1]]
    left = [raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)])]
    return int((e - s).sum()), len(s), b"".join(left)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, n_spans, kept binary, kept_sha256)``: one row per document.

    Texts are UTF-8 bytes; null is empty.  Documents shorter than LENGTH lose nothing.  Rows with
    null or equal ids follow the order of id (null last), then text: of equal rows the first keeps
    its bytes.  Other columns are ignored.  Intervals of a document, a few bytes for each 35 of
    its text, are gathered with it.
    """
    rows, key = keyed(docs, id_col, text_col)
    texts = rows.select(F.col(key).alias("key"), text_of(text_col).cast("binary").alias("text"))
    found = repeated_intervals(texts)
    per_doc = found.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    ids = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"))
    kind = docs.schema[id_col].dataType
    joined = _pack(texts).join(per_doc, F.col("key") == F.col("of"), "left").select("key", "packed", "spans")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out = []
                for key, packed, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    raw = zstandard.decompress(packed.as_buffer())
                    s, e = (f.to_numpy() for f in spans.values.flatten()) if spans.is_valid else ((), ())
                    gone, runs, kept = _kept(raw, s, e)
                    out.append((key, len(raw), gone, runs, kept, hashlib.sha256(kept).hexdigest()))
                kinds = [*[pa.int64()] * 4, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    result = joined.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    if "row_number" in key:
        result = result.join(ids, "key")
    else:
        result = result.withColumn("id", F.col("key").cast(kind))
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
