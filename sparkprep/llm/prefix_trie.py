"""Trie of conversation prefixes, from vertical bitmaps.

Method: conversations are dealt in cells of up to ``CELL_CONVERSATIONS`` neighbouring ids and
``WINDOW`` depths.  A cell indexes every (position, turn) as a bitset over its conversations
and walks depth first: the intersection of a node's bitset with the posting of a turn is a
child, its popcount the members in this cell, and the members without a further turn its end
list.  A node is named by 128 bits that follow from its turns alone, so the cells' pieces of a
node meet in one small aggregate.  Nodes with a single member need nothing more; sums over the
subtrees of shared nodes are made by doubling, each node adding the sums of its descendants
1, 2, 4, ... levels below, in as many rounds as the logarithm of the depth.

Scale: no conversation, first turn or group of copies is one task's work.  Rows are sorted by
range with a tie-breaker, so a conversation of any length is cut over tasks; a parent with many
children is looked up through ``BUCKETS`` requests instead of by its hot key; the end list of a
node arrives as one row per cell.  Nothing but these cells is ever held in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, save, small_batches

CELL_CONVERSATIONS = 1024
WINDOW = 256               # depths of a cell
BLOCK = 4096               # turns of one conversation that one join key may hold
BUCKETS = 1024             # requests for one parent node
WORD = "[^\\x20\\x09-\\x0D]+"


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``(conv, turn, t, words)``: t is 16 bytes of the SHA-256 of role and text, words the words of the text.

    Null role or text counts as empty; rows without a conversation id are left out; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.where(F.col(f"`{conv_col}`").isNotNull())
            .select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                    F.unhex(F.substring(digest, 1, 32)).alias("t"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")))


def _count_along(batches):
    """Adds to rows sorted by conversation their place in it, within this task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        first = np.repeat(new, np.diff(np.r_[new, len(conv)]))
        index = np.arange(len(conv)) - first
        if conv[0] == last:
            index[: new[1] if len(new) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(index[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(index), batch.column(1), batch.column(2)],
            ["conv", "part", "index", "t", "words"])


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place, as (part, index), and per (conv, part) the rows before it and in all.

    Order: turn (null first), then t.  Rows are sorted by range, equal ones told apart by their
    place in the input, so a conversation of any length spreads over tasks.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("arrival")]
    dealt = (turns.withColumn("arrival", F.monotonically_increasing_id())
             .repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order))
    placed = save(dealt.select("conv", "t", "words").mapInArrow(
        _count_along, "conv long, part int, index long, t binary, words long"), "trie_turns")
    counts = placed.groupBy("conv", "part").agg((F.max("index") + 1).alias("n"))
    along = Window.partitionBy("conv").orderBy("part")          # one row a task that holds the conversation
    places = counts.select("conv", "part", "n",
                           F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    return placed, save(places, "trie_places")


def sequences(turns: DataFrame, heads: Column | None = None, source: Column | None = None, most: int = 0) -> DataFrame:
    """``(conv, depth, length, t, words)``: each conversation's turns at depths 1 to length, below the textless root.

    With ``heads`` (at most ``most``) and ``source``, expressions over ``conv``, a conversation's first
    ``heads`` turns are replaced by those of conversation ``source``: all if that has fewer, none if it is absent.
    Every conversation has its root row, also if it has no turn left.
    """
    placed, places = _numbered(turns)
    places = places.withColumn("h", (heads if heads is not None else F.lit(0)).cast("long"))
    if most:
        places = places.withColumn("source", source)
        wanted = placed.where(F.col("index") < most).join(places.select("conv", "part", "before"), ["conv", "part"])
        first = (wanted.withColumn("at", F.col("before") + F.col("index")).where(F.col("at") < most)
                 .groupBy(F.col("conv").alias("source"))
                 .agg(F.sort_array(F.collect_list(F.struct("at", "t", "words"))).alias("head")))
        places = places.join(first, "source", "left").withColumn(
            "head", F.slice(F.coalesce("head", F.array()), 1, F.least(F.col("h"), F.lit(most)).cast("int")))
    else:
        places = places.withColumn("head", F.array().cast("array<struct<at:bigint,t:binary,words:bigint>>"))
    places = places.withColumn("taken", F.size("head").cast("long"))
    places = save(places.withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "trie_plan")
    blocks = places.select("conv", "part", "before", "h", "taken", "length",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    own = (placed.withColumn("block", F.expr(f"index div {BLOCK}")).join(blocks, ["conv", "part", "block"])
           .where(F.col("before") + F.col("index") >= F.col("h"))
           .select("conv", (F.col("before") + F.col("index") - F.col("h") + F.col("taken") + 1).alias("depth"),
                   "length", "t", "words"))
    root = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(b"").alias("t"), F.lit(0).cast("long").alias("words"))
    top = (places.where("before = 0").select("conv", "length", F.posexplode(F.concat(F.array(root), "head")).alias("depth", "turn"))
           .select("conv", F.col("depth").cast("long").alias("depth"), "length", "turn.t", "turn.words"))
    return own.unionByName(top)


def _cells(batches):
    """Arrow batches of rows sorted by (window, conv, depth), regrouped into whole cells."""
    held, count, seen = [], 0, (None, None)
    for batch in batches:
        window, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (window[1:] != window[:-1])])
        begin = 0
        for s in starts:
            now = (int(window[s]), int(conv[s]))
            if now == seen:
                continue
            if seen[0] is not None and (now[0] != seen[0] or count == CELL_CONVERSATIONS):
                if s > begin:
                    held.append(batch.slice(begin, s - begin))
                yield pa.Table.from_batches(held)
                held, count, begin = [], 0, s
            seen, count = now, count + 1
        if begin < len(conv):
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def walk(turns: list, start: list):
    """Depth-first walk of one cell: ``turns[slot]`` are a conversation's turns, ``start[slot]`` the node above them.

    Yields ``(level, slot, turn, parent, node, members)``, members being a bitset over slots whose
    lowest is slot.  Nodes and turns are pairs of longs; a node is its parent xor the turn.
    """
    postings: dict = {}
    for slot, row in enumerate(turns):
        bit = 1 << slot
        for level, turn in enumerate(row):
            key = level, turn
            postings[key] = postings.get(key, 0) | bit
    reach: list[int] = []                      # conversations that have a turn at each level
    for slot, row in enumerate(turns):
        while len(reach) < len(row):
            reach.append(0)
    ends: dict = {}
    for slot, row in enumerate(turns):
        ends[len(row)] = ends.get(len(row), 0) | 1 << slot
    alive = 0
    for level in range(len(reach), 0, -1):
        alive |= ends.get(level, 0)
        reach[level - 1] = alive
    tops: dict = {}
    for slot, node in enumerate(start):
        tops[node] = tops.get(node, 0) | 1 << slot
    stack = [(members, 0, node) for node, members in tops.items()]
    while stack:
        members, level, parent = stack.pop()
        rest = members & reach[level] if level < len(reach) else 0
        while rest:
            slot = (rest & -rest).bit_length() - 1
            turn = turns[slot][level]
            child = rest & postings[level, turn]
            rest ^= child
            node = parent[0] ^ turn[0], parent[1] ^ turn[1]
            yield level, slot, turn, parent, node, child
            stack.append((child, level + 1, node))


_PIECES = ("x long, y long, px long, py long, depth long, words long, conv long, n long, ends array<long>")


def _pieces(batches):
    """Nodes of every cell, with the members that end there."""
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    names = [f.split()[0] for f in _PIECES.split(", ")]
    for cell in _cells(batches):
        cols = {n: cell.column(n).to_numpy() for n in cell.column_names}
        conv = cols["conv"]
        cuts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        stops = np.r_[cuts[1:], len(conv)]
        pairs = list(zip(cols["h1"].tolist(), cols["h2"].tolist()))
        turns = [pairs[a:b] for a, b in zip(cuts, stops)]
        start = list(zip(cols["c1"][cuts].tolist(), cols["c2"][cuts].tolist()))
        base, ids = int(cols["depth"][0]), conv[cuts].tolist()
        length, words = cols["length"][cuts].tolist(), cols["words"].tolist()
        finals: dict = {}
        for slot, n in enumerate(length):
            finals[n] = finals.get(n, 0) | 1 << slot
        out: list = [[] for _ in names]
        for level, slot, _, parent, node, members in walk(turns, start):
            depth, over = base + level, []
            last = members & finals.get(depth, 0)
            while last:
                one = (last & -last).bit_length() - 1
                over.append(ids[one])
                last &= last - 1
            for column, value in zip(out, (*node, *parent, depth, words[cuts[slot] + level], ids[slot],
                                           members.bit_count(), over or None)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def node_pieces(rows: DataFrame) -> DataFrame:
    """Every cell's nodes of ``sequences``: (x, y) names a node, (px, py) its parent; n members and the ends of this cell."""
    rows = save(rows.select("conv", "depth", "length", "words", F.expr(f"depth div {WINDOW}").alias("window"),
                            F.xxhash64("depth", "t").alias("h1"), F.xxhash64("t", "depth").alias("h2")), "trie_rows")
    # the name of the node above a later window: the turns of all windows before it
    of_window = (rows.where(F.col("length") >= WINDOW).groupBy("conv", "window")
                 .agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")))
    before = Window.partitionBy("conv").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    carry = of_window.select("conv", "window", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2"))
    none = F.lit(0).cast("long")
    both = (rows.where("window = 0").withColumns({"c1": none, "c2": none})
            .unionByName(rows.where("window > 0").join(carry, ["conv", "window"])))
    names = ["window", "conv", "depth", "length", "words", "h1", "h2", "c1", "c2"]
    dealt = (both.select(*names).repartitionByRange(partitions(rows.sparkSession), "conv", "window")
             .sortWithinPartitions("window", "conv", "depth"))
    return dealt.mapInArrow(_pieces, _PIECES)


def _follow(rows: DataFrame, table: DataFrame, of: tuple[str, str], own: tuple[str, str]) -> DataFrame:
    """``rows`` left joined to ``table``, unique by (x, y), on columns ``of``, which may hold hot values.

    Rows ask in ``BUCKETS`` groups by their own name; a group asks once and shares the answer.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*own), F.lit(BUCKETS)))
    asked = rows.where(F.col(of[0]).isNotNull()).select(*of, "bucket").distinct()
    named = table.select(F.col("x").alias(of[0]), F.col("y").alias(of[1]), *[c for c in table.columns if c not in ("x", "y")])
    answers = asked.join(named, list(of))
    return rows.join(answers, [*of, "bucket"], "left").drop("bucket")


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """``(x, y, leaves, saved)`` summed over subtrees, for a tree of ``(x, y, up_x, up_y, leaves, saved)``."""
    now = save(shared, "trie_sums")
    while not now.where("up_x IS NOT NULL").isEmpty():
        below = (now.where("up_x IS NOT NULL").groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y"))
                 .agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved")))
        higher = _follow(now, now.select("x", "y", F.col("up_x").alias("next_x"), F.col("up_y").alias("next_y")),
                         ("up_x", "up_y"), ("x", "y"))
        now = save(higher.join(below, ["x", "y"], "left")
                   .select("x", "y", F.col("next_x").alias("up_x"), F.col("next_y").alias("up_y"),
                           (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                           (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "trie_sums")
    return now.select("x", "y", "leaves", "saved")


def prefix_trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and end lists of the trie of ``sequences``.

    Nodes, one row each: ``x, y`` (the name), ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``
    (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree, itself
    included) and ``saved_tokens`` (over the subtree, (members - 1) times the words of the node's turn).
    End lists: ``(x, y, first, ends)``, ascending chunks of the ids that end at a node; the chunks of a
    node do not overlap.  No conversation: no rows.
    """
    small_batches(rows.sparkSession)
    pieces = save(node_pieces(rows), "trie_pieces")
    ends = pieces.where("ends IS NOT NULL").select("x", "y", F.col("ends")[0].alias("first"), "ends")
    nodes = save(pieces.groupBy("x", "y").agg(
        F.min("px").alias("px"), F.min("py").alias("py"), F.min("depth").alias("depth"), F.min("words").alias("words"),
        F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.coalesce(F.size("ends"), F.lit(0))).alias("n_ends")),
        "trie_nodes")
    shared = nodes.where("n_convs > 1")
    bucketed = nodes.withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.lit(BUCKETS)))
    asked = bucketed.where("depth > 0").groupBy("px", "py", "bucket").agg(
        F.count("*").alias("kids"), F.count_if(F.col("n_convs") == 1).alias("solo"))
    answers = save(asked.join(shared.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent")),
                              ["px", "py"]), "trie_parents")
    kids = answers.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.sum("kids").alias("kids"), F.sum("solo").alias("solo"))
    sized = shared.join(kids, ["x", "y"], "left").select(
        "x", "y", F.when(F.col("depth") > 0, F.col("px")).alias("up_x"), F.when(F.col("depth") > 0, F.col("py")).alias("up_y"),
        F.coalesce("kids", F.lit(0)).alias("kids"),
        # a child with one member heads a chain, which has one leaf and saves nothing
        F.when(F.col("kids").isNull(), F.lit(1)).otherwise(F.col("solo")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sized = save(sized, "trie_shared")
    sums = _subtree_sums(sized.drop("kids")).join(sized.select("x", "y", "kids"), ["x", "y"])
    known = bucketed.join(answers.select("px", "py", "bucket", "parent"), ["px", "py", "bucket"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    # a node with one member has at most one child, unless it is where its conversation ends
    alone = known.where("n_convs = 1").select(
        "x", "y", "depth", "conv_id", parent, "n_convs", (1 - F.col("n_ends")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    many = known.where("n_convs > 1").join(sums, ["x", "y"]).select(
        "x", "y", "depth", "conv_id", parent, "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return alone.unionByName(many), ends


def _hash_lists(batches):
    """SHA-256 of the comma-joined ids of each node, from chunks sorted by (x, y, first)."""
    now, state = None, None
    for batch in batches:
        names, digests = [], []
        for x, y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if (x, y) == now:
                state.update(b"," + text)
                continue
            if now is not None:
                names.append(now)
                digests.append(state.hexdigest())
            now, state = (x, y), hashlib.sha256(text)
        yield _digests(names, digests)
    if now is not None:
        yield _digests([now], [state.hexdigest()])


def _digests(names, digests):
    return pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()),
                                       pa.array(digests, pa.string())], ["x", "y", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(x, y, ends_sha256)``.  The digest of one list runs over it in order, chunk by chunk, holding one batch."""
    dealt = (ends.repartition(partitions(ends.sparkSession), "x", "y").sortWithinPartitions("x", "y", "first")
             .select("x", "y", "ends"))
    return dealt.mapInArrow(_hash_lists, "x long, y long, ends_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """Contract form over rebuilt conversations: up to crc32(id) % 4 first turns come from conversation id - id % 20."""
    conv = F.col("conv")
    rows = sequences(turns_of(conversations), heads=F.crc32(conv.cast("string").cast("binary")) % 4,
                     source=conv - conv % 20, most=3)
    nodes, ends = prefix_trie(rows)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(end_digests(ends), ["x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
