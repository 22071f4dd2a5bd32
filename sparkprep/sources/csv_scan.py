"""A CSV scan whose quoted cells may hold line breaks and whose files are read in ranges.

Spark's own reader takes a whole file in one task as soon as a cell may hold a line break, since
a range does not know whether it starts inside quotes.  Here the file is read as lines by the
splittable text reader, and each range is a function of two states, outside and inside a quoted
cell, to two states.  A first pass finds those functions (two bits a range); composed along each
file they give the state at the start of every range.  The second pass then joins the lines of a
record and hands it to ``from_csv``.  A record that straddles ranges leaves a piece at each side;
pieces, at most two a range, meet by their record and are joined there.

A cell is quoted if a quote is its first character; quotes inside it are doubled; quotes
anywhere else are ordinary characters.  Records end in a line feed, with or without a carriage
return before it; inside quotes both stay.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The functions below travel to the Python workers by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A cell: quoted (with whatever stands between its closing quote and the comma), plain, or empty.
_CELL = '(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
#: Lines after which one is outside quotes, for a line that starts outside and one that starts inside.
_FROM_OUTSIDE = f"^{_CELL}(?:,{_CELL})*$"
_FROM_INSIDE = f'^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_CELL})*$'


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line) in file order within every range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").alias("line")))


def _steps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the lines that hold a quote, and whether one is inside quotes after each, from either state."""
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    some = lines.take(pa.array(at))
    return (at, ~pc.match_substring_regex(some, _FROM_OUTSIDE).to_numpy(zero_copy_only=False),
            ~pc.match_substring_regex(some, _FROM_INSIDE).to_numpy(zero_copy_only=False))


def _ranges(batches):
    """Consecutive (file, block, lines) of Arrow batches (file, block, line); a range may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy(zero_copy_only=False)
        file = batch.column(0).dictionary_encode()
        code = file.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])])
        for a, b in zip(cuts, np.r_[cuts[1:], len(block)]):
            yield file.dictionary[code[a]].as_py(), int(block[a]), batch.column(2).slice(a, b - a)


_FUNCTIONS = "file string, block long, after_outside boolean, after_inside boolean, ends_outside boolean, ends_inside boolean"


def _functions(batches):
    """Of every range of a task, from either state: whether one is inside quotes after it, and whether a record ends in it."""
    now, states, ends, out = None, [False, True], [False, False], []
    for file, block, lines in _ranges(batches):
        if (file, block) != now:
            if now:
                out.append((*now, *states, *ends))
            now, states, ends = (file, block), [False, True], [False, False]
        at, outside, inside = _steps(lines)
        plain = len(at) < len(lines)
        for i, state in enumerate(states):
            met = {state} if plain and (not len(at) or at[0] > 0) else set()
            for k, (from_out, from_in) in enumerate(zip(outside.tolist(), inside.tolist())):
                state = from_in if state else from_out
                met.add(state)
            # a line without a quote ends a record wherever the state is outside, as does a line that leads there
            states[i], ends[i] = state, ends[i] or False in met
    if now:
        out.append((*now, *states, *ends))
    kinds = [pa.string(), pa.int64()] + [pa.bool_()] * 4
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                     [c.split()[0] for c in _FUNCTIONS.split(", ")])


@dataclass(frozen=True)
class Start:
    """Where a range begins: its number in the file, whether inside quotes, and the range in which the
    record that is open there began; ``ends``: whether any record ends in it."""

    number: int
    inside: bool
    begun: int
    ends: bool


def range_starts(spark: SparkSession, path) -> tuple[dict[str, dict[int, Start]], bool]:
    """file -> block -> ``Start``, and whether any record is left open at the end of a range.

    One small row for each range reaches the driver: one for every
    ``spark.sql.files.maxPartitionBytes`` of input.
    """
    rows = _lines(spark, path).mapInArrow(_functions, _FUNCTIONS).collect()
    found: dict[str, dict[int, Start]] = {}
    inside, begun, straddles = False, 0, False
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        of_file = found.setdefault(r["file"], {})
        number = len(of_file)
        if not number:
            inside = False
        ends = r["ends_inside"] if inside else r["ends_outside"]
        of_file[r["block"]] = Start(number, inside, begun if inside else number, ends)
        after = r["after_inside"] if inside else r["after_outside"]
        if after and (ends or not inside):
            begun = number                   # the record that is open after this range begins in it
        inside = after
        straddles = straddles or after
    return found, straddles


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Records of whole lines that begin at ``starts``."""
    offsets = pa.array(np.r_[starts, len(lines)].astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


def _states(lines: pa.Array, inside: bool) -> np.ndarray:
    """Whether one is inside quotes after each line."""
    at, outside, within = _steps(lines)
    after, state, last = np.zeros(len(lines), bool), inside, 0
    for i, from_out, from_in in zip(at.tolist(), outside.tolist(), within.tolist()):
        after[last:i] = state
        state = from_in if state else from_out
        after[i], last = state, i + 1
    after[last:] = state
    return after


def _assemble(shared, pieces: bool):
    """Records that lie whole in a range (``pieces`` false), or the pieces of those that do not.

    A piece is (file, record, part, text): the record is named by the range in which it begins,
    the part by the range it comes from.
    """
    def rows(out):
        if not pieces:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          ["file", "record", "part", "text"])

    def run(batches):
        now, start, inside, held, own, header = None, None, False, [], True, False
        for file, block, lines in _ranges(batches):
            if (file, block) != now:
                if held and pieces:              # open at the end of the range
                    yield rows([(now[0], start.number if own else start.begun, start.number, "\n".join(held))])
                start = shared.value.get(file, {}).get(block)
                if start is None:
                    raise ValueError("the files or their ranges changed between two passes of the CSV scan")
                # own: the open record begins in this range; header: it is the first of its file
                now, inside, held, own, header = (file, block), start.inside, [], not start.inside, start.number == 0
            after = _states(lines, inside)
            ends = np.flatnonzero(~after)        # lines that end a record
            inside = bool(after[-1])
            if not len(ends):
                held += lines.to_pylist()
                continue
            first = int(ends[0]) + 1
            text = "\n".join(held + lines.slice(0, first).to_pylist())
            if not own:
                if pieces:
                    yield rows([(file, start.begun, start.number, text)])
            elif not pieces and not header:
                yield rows([text])
            own, header = True, False
            rest = lines.slice(first, int(ends[-1]) + 1 - first)
            if len(rest) and not pieces:
                yield pa.RecordBatch.from_arrays([_joined(rest, np.r_[0, ends[1:-1] + 1 - first])], ["record"])
            held = lines.slice(int(ends[-1]) + 1).to_pylist()
        if held and pieces:
            yield rows([(now[0], start.number if own else start.begun, start.number, "\n".join(held))])

    return run


def records(spark: SparkSession, path) -> DataFrame:
    """``(record)``: the records of headed CSV files as text, each file's first one, its header, left out.

    Empty records are left out too; a quote that is never closed makes a record of the rest of its file.
    The files are read twice, and once more if a record straddles two ranges; every pass uses all cores
    whatever the size of a file.
    """
    starts, straddles = range_starts(spark, path)
    shared = spark.sparkContext.broadcast(starts)             # a few bytes for each range
    whole = _lines(spark, path).mapInArrow(_assemble(shared, False), "record string")
    if straddles:
        parts = _lines(spark, path).mapInArrow(_assemble(shared, True), "file string, record long, part long, text string")
        # a header that does not end in its first range
        headers = [f for f, blocks in starts.items() if not min(blocks.values(), key=lambda s: s.number).ends]
        if headers:
            parts = parts.where(~(F.col("file").isin(headers) & (F.col("record") == 0)))
        met = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
        whole = whole.unionByName(met.select(F.array_join("parts.text", "\n").alias("record")))
    trimmed = F.regexp_replace("record", "\r$", "")
    return whole.select(trimmed.alias("record")).where("record <> ''")
