"""Pack examples into training sequences by vector bin packing.

Every example has a demand in three dimensions: tokens, segments (one) and loss-bearing
tokens.  The open sequence takes, among the waiting examples that fit in all three, the one
whose demand has the largest dot product with what is still free (both as shares of the
limits).  When none fits whole, one is cut to fill the sequence.  Packing is local to a task
over a bounded set of waiting examples, so nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encode_batches

WAITING = 512               # examples a task keeps to choose from
TASK_SEQUENCES = 1 << 40    # sequence ids of a task start at its number times this


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    min_cut: int = 16       # free tokens below this are padded, not filled by a cut

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least one")


class Example:
    """What is left of an example: ids from ``at`` on; loss: ranges that bear loss (None: all)."""

    __slots__ = ("id", "ids", "at", "bearing")

    def __init__(self, ident, ids, loss):
        self.id, self.ids, self.at = ident, ids, 0
        if loss is None:
            self.bearing = None
        else:                       # bearing[i]: loss-bearing tokens before i
            flags = np.zeros(len(ids) + 1, np.int64)
            for r in loss:
                flags[max(0, r[0]) + 1:max(0, r[1]) + 1] = 1
            self.bearing = np.cumsum(flags)

    def left(self) -> int:
        return len(self.ids) - self.at

    def loss(self, length: int) -> int:
        return length if self.bearing is None else int(self.bearing[self.at + length] - self.bearing[self.at])

    def prefix(self, tokens: int, loss: int) -> int:
        """Tokens that can be cut off the front within both numbers."""
        tokens = min(tokens, self.left())
        if self.bearing is None:
            return min(tokens, loss)
        return int(np.searchsorted(self.bearing[self.at:self.at + tokens + 1], self.bearing[self.at] + loss, "right")) - 1


class Packer:
    """Feed examples with add(), end with finish(); out collects pieces.

    A piece is (id, start, length, crc, example tokens, loss tokens, sequence, offset).
    """

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.sequence, self.out = limits, first_sequence, []
        self.waiting: list[Example] = []
        self.need = np.zeros((0, 3))
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, example: Example) -> None:
        lim = self.limits
        while example.left() >= lim.tokens and example.loss(lim.tokens) <= lim.loss:
            self._emit(example, lim.tokens, 0)
            self.sequence += 1
        if example.left():
            self.waiting.append(example)
        if len(self.waiting) >= WAITING:
            self._measure()
            while len(self.waiting) > WAITING // 2:
                self._fill()

    def finish(self) -> None:
        self._measure()
        while self.waiting:
            self._fill()

    def _measure(self) -> None:
        """A demand is capped at the limits: longer examples go in by cuts."""
        self.need = np.array([[e.left(), 1, e.loss(e.left())] for e in self.waiting], float).reshape(-1, 3)

    def _emit(self, e: Example, length: int, offset: int) -> None:
        part = np.ascontiguousarray(e.ids[e.at:e.at + length], "<u4")
        self.out.append((e.id, e.at, length, zlib.crc32(part), len(e.ids), e.loss(length), self.sequence, offset))
        e.at += length

    def _drop(self, i: int) -> None:
        self.waiting[i] = self.waiting[-1]
        self.need[i] = self.need[len(self.waiting) - 1]
        self.waiting.pop()
        self.need = self.need[:len(self.waiting)]

    def _fill(self) -> None:
        """One sequence; the last of a task, if not full, becomes sequences of power-of-two lengths."""
        free, offset, placed = self.cap.copy(), 0, []
        while self.waiting and free[0] >= 1 and free[1] >= 1:
            fits = (self.need <= free).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.need / self.cap) @ (free / self.cap), -1.0)
                i = int(score.argmax())
                length = self.waiting[i].left()
            else:
                if placed and free[0] < self.limits.min_cut:
                    break
                score = np.minimum(self.need, free) / self.cap @ (free / self.cap)
                i = int(score.argmax())
                length = self.waiting[i].prefix(int(free[0]), int(free[2]))
                if placed and length < self.limits.min_cut:
                    break
            e = self.waiting[i]
            free -= (length, 1, e.loss(length))
            placed.append((e, e.at, length))
            e.at += length
            offset += length
            if e.left():
                self.need[i] = (e.left(), 1, e.loss(e.left()))
            else:
                self._drop(i)
        lengths = [self.limits.tokens]
        if not self.waiting and offset < self.limits.tokens:
            lengths = [1 << b for b in range(offset.bit_length() - 1, -1, -1) if offset >> b & 1]
        self._write(placed, lengths)

    def _write(self, placed, lengths) -> None:
        rooms = iter(lengths)
        room, offset = next(rooms), 0
        for e, start, length in placed:
            end, e_at = start + length, e.at
            while start < end:
                if room == offset:
                    self.sequence += 1
                    room, offset = next(rooms), 0
                take = min(end - start, room - offset)
                e.at = start
                self._emit(e, take, offset)
                start, offset = start + take, offset + take
            e.at = e_at
        self.sequence += 1


def pack(examples: DataFrame, limits: Limits = Limits(), id_type: str = "<u2") -> DataFrame:
    """Pieces of ``(id, ids binary[, loss array<struct<s int, e int>>])``.

    ``ids`` holds little-endian integers of ``id_type``; ``loss`` the ranges of tokens that bear
    loss (no such column, or null: all of them).  Returns id, start, length, ids_crc32, tokens
    (of the example), loss_tokens (of the piece), sequence_id, offset.  Every token of every
    example lies in one piece; a piece lies in one sequence; examples without tokens (null or
    empty ids) have none.  Null and repeated ids are carried along.  sequence_id is unique, and
    the same when a task is run again on the same rows.
    """
    has_loss = "loss" in examples.columns
    kind = examples.schema["id"].dataType.simpleString()
    cols = ["id", "ids", "loss"] if has_loss else ["id", "ids"]
    return examples.select(*cols).mapInArrow(_packed(limits, id_type, has_loss), f"id {kind}, {_PIECES}")


def pack_texts(rows: DataFrame, tokenizer: str, end_id: int | None, limits: Limits = Limits(),
               id_type: str = "<u2") -> DataFrame:
    """``pack`` of the token ids of ``(key, id, text)``, made in the same task; all tokens bear loss."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)
    into = _packed(limits, id_type, False)

    def run(batches):
        encoded = encode_batches(batches, shared.value, end_id)
        return into(pa.RecordBatch.from_arrays([b.column(1), b.column(3)], ["id", "ids"]) for b in encoded)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("key", "id", "text").mapInArrow(run, f"id {kind}, {_PIECES}")


_PIECES = ("start long, length long, ids_crc32 long, tokens long, loss_tokens long, sequence_id long, offset long")


def _packed(limits: Limits, id_type: str, has_loss: bool):
    def run(batches):
        packer = Packer(limits, TaskContext.get().partitionId() * TASK_SEQUENCES)
        kind = None

        def rows():
            out, packer.out = packer.out, []
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["id", "start", "length", "ids_crc32", "tokens", "loss_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.column(0).type
            loss = batch.column(2).to_pylist() if has_loss else None
            for i, (ident, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                raw = ids.as_buffer() if ids.is_valid else b""
                ranges = loss[i] if has_loss and loss[i] is not None else None
                ranges = None if ranges is None else [(r["s"], r["e"]) for r in ranges]
                packer.add(Example(ident, np.frombuffer(raw, id_type), ranges))
                if len(packer.out) > 20_000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return run
