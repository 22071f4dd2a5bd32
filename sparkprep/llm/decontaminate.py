"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every run of m characters of a benchmark item is a segment.  A document holds a segment with at
most e edits only if the two share at least m + 1 - q (e + 1) character q-grams, all on e + 1
neighbouring diagonals.  So shared q-grams are found by table lookup, places where too few of
them are close together are passed over, the rest are counted in overlapping bands of 2 (e + 1)
diagonals, by whole items and then by segments, and segments that meet the bound are verified by
an alignment within the band.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, keyed, text_of

Q = 8
TABLE_BITS = 22
BLOCK_CHARS = 2_000_000     # benchmark characters searched for at a time
TEXT_CHARS = 1_500_000      # document characters looked at together, a document at least
GAP = 64                    # characters that stand for nothing between documents
POSTINGS = 4_000_000        # places of q-grams in items looked at together
ROWS = 4096                 # segments aligned together


@dataclass(frozen=True)
class Match:
    """A segment counts as found with at most ``edits`` edits for each character of it; items
    below ``least`` normal characters count only verbatim and between word borders, and those
    below Q are not searched."""

    segment: int = 80
    stride: int = 1
    edits: float = 0.1
    least: int = 24

    def budget(self, m: int) -> int:
        """Edits allowed in m characters; never so many that the bound on q-grams would vanish."""
        return 0 if m < self.least else max(0, min(int(self.edits * m), (m - Q) // Q))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """Eight folded characters as one number, for every start."""
    a = (codes ^ codes >> 8).astype(np.uint8)
    b = a[:-1].astype(np.uint16) | a[1:].astype(np.uint16) << 8
    c = b[:-2].astype(np.uint32) | b[2:].astype(np.uint32) << 16
    return c[:-4].astype(np.uint64) | c[4:].astype(np.uint64) << np.uint64(32)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


class Searcher:
    """Segments of some items, and the q-grams that lead to them."""

    def __init__(self, items: list[tuple[object, str]], match: Match):
        self.match = match
        self.texts = [text for _, text in items]
        codes = [_codes(text) for _, text in items]
        self.length = np.array([len(c) for c in codes])
        self.start = np.cumsum(self.length) - self.length
        self.codes = np.concatenate([*codes, np.zeros(match.segment, "<u4")])
        grams = [_grams(c) for c in codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.item, self.pos = item[order], pos[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_slots(self.grams)] = True
        self.size = np.minimum(self.length, match.segment)          # of each segment of an item
        self.budget = np.array([match.budget(m) for m in self.size])
        self.need = self.size + 1 - Q * (self.budget + 1)
        self.half = int(self.budget.max()) + 1                      # diagonals of half a band
        self.offset = int(self.length.max()) + 2 * self.half        # keeps band numbers positive
        self.near = int((self.size + self.budget).max())            # characters a match can span

    def close(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shared q-grams that have enough of their like within one match's span, and
        which q-gram stands there."""
        grams = _grams(codes)
        hit = self.table[_slots(grams)]
        total = np.r_[0, np.cumsum(hit)]
        span = max(1, self.near - Q + 1)
        starts = np.arange(len(hit))
        dense = total[np.minimum(starts + span, len(hit))] - total[starts] >= int(self.need.min())
        if not dense.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cover = np.zeros(len(hit) + 1, np.int64)
        at = np.flatnonzero(dense)
        np.add.at(cover, at, 1)
        np.add.at(cover, np.minimum(at + span, len(hit)), -1)
        places = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        where = np.searchsorted(self.grams, grams[places])
        where[where == len(self.grams)] = 0
        real = self.grams[where] == grams[places]
        return places[real], where[real]

    def postings(self, places: np.ndarray, grams: np.ndarray):
        """(item and half band as one number, place in the item) of shared q-grams, some at a time."""
        upto = np.cumsum(self.counts[grams])
        lo = 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + POSTINGS)))
            where = grams[lo:hi]
            n = self.counts[where]
            each = np.repeat(np.arange(len(where)), n)
            post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[where][each]
            pos = self.pos[post]
            yield self.item[post] << 40 | (places[lo:hi][each] - pos + self.offset) // self.half, pos
            lo = hi

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start of the segment in it, first diagonal) of the bands that meet the bound on
        shared q-grams: first by whole items, then by the segments of those that are left."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, grams = self.close(codes)
        if not len(places):
            return none
        found = [np.unique(key, return_counts=True) for key, _ in self.postings(places, grams)]
        halves, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        count = np.r_[np.bincount(back, weights=np.concatenate([f[1] for f in found])), 0]

        def held(keys):
            at = np.searchsorted(halves, keys)
            return np.where(halves[np.minimum(at, len(halves) - 1)] == keys, count[at], 0)

        keys = np.sort(np.r_[halves, halves - 1])
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        keys = keys[held(keys) + held(keys + 1) >= self.need[keys >> 40]]
        if not len(keys):
            return none
        hits = []
        for half, pos in self.postings(places, grams):
            for key in (half, half - 1):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                real = keys[at] == key
                hits.append(at[real] * self.offset + pos[real])
        hits = np.sort(np.concatenate(hits))
        hits = hits[np.r_[True, hits[1:] != hits[:-1]]]
        at, pos = hits // self.offset, hits % self.offset
        # the q-grams from one to the need-th after it are within the segments that start in [lo, hi]
        item = keys[at] >> 40
        last = np.arange(len(hits)) + self.need[item] - 1
        full = last < len(hits)
        last = np.minimum(last, len(hits) - 1)
        lo = np.maximum(pos[last] - (self.size[item] - Q), 0)
        hi = np.minimum(pos, self.length[item] - self.size[item])
        ok = full & (at[last] == at) & (lo <= hi)
        at, item, lo, hi = at[ok], item[ok], lo[ok], hi[ok]
        if not len(at):
            return none
        same = np.r_[False, at[1:] == at[:-1]]
        lo = np.where(same, np.maximum(lo, np.r_[0, hi[:-1]] + 1), lo)
        n = np.maximum(hi - lo + 1, 0)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at, item = np.repeat(at, n), np.repeat(item, n)
        ok = (start % self.match.stride == 0) | (start == self.length[item] - self.size[item])
        at, item, start = at[ok], item[ok], start[ok]
        return item, start, (keys[at] & (1 << 40) - 1) * self.half - self.offset + start

    def align(self, codes: np.ndarray, item: np.ndarray, start: np.ndarray, diagonal: np.ndarray):
        """Fewest edits of each segment within its band, and the end of that match in ``codes``;
        segments that pass their budget on the way are given up.  ``codes`` has an edge of
        ``self.edge()`` characters at both ends, which diagonals do not count."""
        width, size, budget = 2 * self.half, self.size[item], self.budget[item]
        most = int(size.max())
        text = codes[diagonal + self.edge() + np.arange(most + width)[:, None]]
        rows = self.codes[self.start[item] + start + np.arange(most)[:, None]]
        best, end = np.full(len(item), 1 << 14), np.zeros(len(item), np.int64)
        kind = np.int8 if most + width < 127 else np.int32          # no cost is higher than that
        live, cost = np.arange(len(item)), np.zeros((width, len(item)), kind)
        ends = set(size.tolist())
        for i in range(most + 1):
            if i in ends:
                done = np.flatnonzero(size[live] == i)
                k = cost[:, done].argmin(axis=0)
                best[live[done]], end[live[done]] = cost[k, done], diagonal[live[done]] + k + i
            if i == most:
                break
            if i % 4 == 0 and i > self.half:
                left = (cost.min(axis=0) <= budget[live]) & (size[live] > i)
                if left.mean() < 0.8:
                    live, cost, text, rows = live[left], cost[:, left], text[:, left], rows[:, left]
                    if not len(live):
                        break
            step = cost + (text[i:i + width] != rows[i]).view(np.int8)
            np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])
            for k in range(1, width):
                np.minimum(step[k], step[k - 1] + 1, out=step[k])
            cost = step
        return best, end

    def whole(self, texts: list[str], starts: np.ndarray, item: np.ndarray, diagonal: np.ndarray):
        """Short items that stand verbatim, between word borders, in a text near these diagonals."""
        pairs = set()
        for place in (diagonal, diagonal + 2 * self.half + self.size[item]):
            text = np.searchsorted(starts, place, "right") - 1
            pairs.update(zip(text.clip(0, len(texts) - 1).tolist(), item.tolist()))
        for text, i in sorted(pairs):
            x = self.texts[i]
            before, after = r"(?<!\w)" if re.match(r"\w", x) else "", r"(?!\w)" if re.search(r"\w\Z", x) else ""
            if re.search(before + re.escape(x) + after, texts[text]):
                yield text, i, 0, 0

    def edge(self) -> int:
        return 2 * self.match.segment + 8 * self.half

    def search(self, texts: list[str]):
        """(text number, item, edits, start of the segment in the item) of every segment found."""
        gap = "\0" * GAP
        codes = _codes(gap.join(texts) + gap)
        starts = np.cumsum([0, *(len(t) + GAP for t in texts)])
        if len(codes) < Q:
            return
        item, start, diagonal = self.bands(codes)
        short = self.length[item] < self.match.least
        yield from self.whole(texts, starts, item[short], diagonal[short])
        item, start, diagonal = item[~short], start[~short], diagonal[~short]
        edge = np.zeros(self.edge(), codes.dtype)
        padded = np.r_[edge, codes, edge]
        for lo in range(0, len(item), ROWS):
            i, s = item[lo:lo + ROWS], start[lo:lo + ROWS]
            best, end = self.align(padded, i, s, diagonal[lo:lo + ROWS])
            ok = best <= self.budget[i]
            text = np.searchsorted(starts, end[ok] - 1, "right") - 1
            yield from zip(text.tolist(), i[ok].tolist(), best[ok].tolist(), s[ok].tolist())


def contaminated(docs: DataFrame, benchmark: DataFrame, match: Match = Match(), id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, <id_col>, <item_col>, n_segments, edits)`` of each document and item it holds a part of.

    Text is compared in lower case with single spaces.  n_segments counts the item's segments
    found, edits is the fewest edits of one.  Null texts and items are passed over; rows with
    null or equal ids are told apart by ``key``; items with equal ids are one item.  The
    benchmark is read in blocks of at most about BLOCK_CHARS characters; each block is sent to
    the tasks and searched for in all documents, so its size has no bound but time.
    """
    spark = docs.sparkSession
    rows, key = keyed(docs, id_col, text_col)
    named = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    id_kind, item_kind = (named.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString())
    schema = f"key long, id {id_kind}, item {item_kind}, start int, edits int"
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        held = [(r["item"], normal(r["text"])) for r in block]
        held = [h for h in held if len(h[1]) >= Q]
        if held:
            parts.append(named.mapInArrow(_search(spark.sparkContext.broadcast(held), match), schema))
    if not parts:
        return spark.createDataFrame([], f"key long, `{id_col}` {id_kind}, `{item_col}` {item_kind}, n_segments long, edits int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return (found.groupBy("key", "id", "item").agg(F.countDistinct("start").alias("n_segments"), F.min("edits").alias("edits"))
            .withColumnRenamed("id", id_col).withColumnRenamed("item", item_col))


def _search(shared, match: Match):
    def run(batches):
        held = shared.value
        searcher = Searcher(held, match)

        def look(batch, lo, texts):
            return [(batch.column(0)[lo + t].as_py(), batch.column(1)[lo + t].as_py(), held[i][0], s, e)
                    for t, i, e, s in searcher.search(texts)]

        for batch in batches:
            out, texts, lo, size = [], [], 0, 0
            for n, text in enumerate(batch.column(2).to_pylist()):
                texts.append(normal(text))
                size += len(texts[-1])
                if size >= TEXT_CHARS:
                    out += look(batch, lo, texts)
                    texts, lo, size = [], n + 1, 0
            if texts:
                out += look(batch, lo, texts)
            out = list(dict.fromkeys(out))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(1).type), pa.array(cols[2]),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                    ["key", "id", "item", "start", "edits"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, match: Match = Match(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that hold no part of a benchmark item."""
    rows, key = keyed(docs, id_col, text_col)
    found = contaminated(rows, benchmark, match, id_col=key, text_col=text_col)
    name = free_name(rows, "__gone")
    gone = found.select(F.col(key).alias(name)).distinct()
    return rows.join(gone, F.col(key) == F.col(name), "left_anti").select(*[f"`{c}`" for c in docs.columns])
