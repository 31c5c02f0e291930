"""The prefix trie of conversations, in minimal-perfect-hash node tables.

A prefix is known by its digest: the exclusive or of one 128-bit hash per turn, taken over the turn's place, role and
text.  A running aggregate gives the digests of all prefixes, and one without the turn's own hash is its parent's.  Rows
are dealt to shards by whole segments of conversations.  Each shard enumerates its distinct digests, gives every one a
slot of a minimal perfect hash, checks that slot and digest belong together, scatters counts into flat arrays and adds
them up through the array of parent slots, deepest slots first.  All sums are per member, so shards that share a node
each hold a part, and one aggregate adds the parts.

What a node sums over its subtree is written as a sum over its members: a member counts the text of a node on its path
unless it is the node's smallest member, so a node with n members counts n - 1 times.  A long conversation is cut into
segments; what later segments hold is carried into the last row of each earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

GROUP = 100  # conversations that start with the same one's turns
HEADS = 6  # a conversation takes over fewer turns than this
_SEGMENT = 4096
_SHARD_ROWS = 200_000
_CHUNK = 1 << 16

_SHARD_DDL = (
    "d1 bigint, d2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_chars bigint"
)
_SHARD_NAMES = [part.split()[0] for part in _SHARD_DDL.split(", ")]


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: level by level, keys alone in their cell get its rank.

    Keys that meet in a cell go on to the next level, under another seed.  ``slots`` looks digests up and compares what
    lies in the slot with what was asked for.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        self._levels: list[tuple[np.ndarray, int]] = []
        used = 0
        while len(first):
            size = 2 * len(first) + 1
            cell = self._cells(first, second, len(self._levels), size)
            single = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(single) - 1 + used
            self._levels.append((np.where(single, rank, -1), size))
            placed = single[cell]
            self.first[rank[cell[placed]]], self.second[rank[cell[placed]]] = first[placed], second[placed]
            used += int(placed.sum())
            first, second = first[~placed], second[~placed]

    def __len__(self) -> int:
        return len(self.first)

    @staticmethod
    def _cells(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (first.view(np.uint64) + np.uint64(2 * level + 1) * second.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(17)) % np.uint64(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, (ranks, size) in enumerate(self._levels):
            at = ranks[self._cells(first[open_], second[open_], level, size)]
            found[open_] = at
            open_ = open_[at < 0]
        known = found >= 0
        known[known] &= (self.first[found[known]] == first[known]) & (self.second[found[known]] == second[known])
        if not known.all():
            raise ValueError("a slot holds another digest than the one looked up")
        return found


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role_key, text_key, chars): turns numbered from 1, texts by their MD5; stored.

    The order is by turn, null first; turns of one number go by the MD5 of role and text.  A null role or text is
    empty.  Rows without a conv_id take no part.  Rows are sorted over all tasks and numbered by the counts per task, so
    a conversation with very many turns is not gathered.
    """
    digest = lambda name: F.unhex(F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")))).alias(f"{name}_key")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), digest("role"), digest("text"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role_key", "text_key", "row"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    line = stored(sorted_.drop("turn", "row").withColumn("line", F.monotonically_increasing_id()), "turns")
    line = line.withColumn("task", F.shiftrightunsigned("line", 33))
    pieces = line.groupBy("conv_id", "task").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("by"))
    at = (F.col("line") + F.col("by")).alias("at")
    return line.join(offsets, ["conv_id", "task"]).select("conv_id", at, "role_key", "text_key", "chars")


def taken_over(conv_id: Column) -> Column:
    """How many of its first turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("bigint")


def with_shared_heads(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation ``conv_id - conv_id % 100``.

    ``h`` is ``taken_over``; where the other conversation has fewer turns all of them are taken, and its own first h
    turns go in any case.  ``ids`` has each conv_id and its number of turns ``n``.
    """
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    lengths = ids.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    own = turns.select("*", base, taken_over(F.col("conv_id")).alias("_h")).filter(F.col("at") > F.col("_h"))
    own = own.join(lengths, "base", "left").withColumn("at", F.col("at") - F.col("_h") + F.least("_h", F.coalesce("_there", F.lit(0))))
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("at") < HEADS)).withColumnRenamed("conv_id", "base")
    heirs = ids.select("conv_id", base, taken_over(F.col("conv_id")).alias("_h"))
    copied = heirs.join(heads, "base").filter(F.col("at") <= F.col("_h"))
    return own.select(*turns.columns).unionByName(copied.select(*turns.columns))


def _prefixes(turns: DataFrame, salt: int, segment: int) -> DataFrame:
    """(conv_id, at, segment, d1, d2, p1, p2, chars, last): digests of each prefix and its parent; stored."""
    hashed = [F.xxhash64(F.lit(2 * salt + i), "at", "role_key", "text_key").alias(f"h{i + 1}") for i in (0, 1)]
    rows = turns.select("conv_id", "at", F.floor(F.col("at") / segment).alias("segment"), "chars", *hashed)
    sums = rows.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    conv = Window.partitionBy("conv_id")
    earlier = conv.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "segment", F.bit_xor("x1").over(earlier).alias("b1"), F.bit_xor("x2").over(earlier).alias("b2"),
        F.lead("segment").over(conv.orderBy("segment")).isNotNull().alias("more"), F.count(F.lit(1)).over(conv).alias("_n"),
    ).filter("_n > 1").drop("_n")
    within = Window.partitionBy("conv_id", "segment")
    upto = within.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select(
        "*", F.bit_xor("h1").over(upto).alias("i1"), F.bit_xor("h2").over(upto).alias("i2"),
        F.lead("at").over(within.orderBy("at")).isNull().alias("ends"),
    )
    all_ = inner.join(sums, ["conv_id", "segment"], "left")
    d = [F.col(f"i{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)]
    p = [value.bitwiseXOR(F.col(f"h{i}")) for i, value in enumerate(d, 1)]
    last = (F.col("ends") & ~F.coalesce("more", F.lit(False))).alias("last")
    return stored(
        all_.select("conv_id", "at", "segment", d[0].alias("d1"), d[1].alias("d2"), p[0].alias("p1"), p[1].alias("p2"), "chars", last),
        "prefixes",
    )


def _owned(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(d1, d2, owner, childless) of each prefix, stored, and whether two prefixes share a digest.

    The same digest has to come with the same parent, depth and length of its last text.
    """
    same = ["at", "p1", "p2", "chars"]
    clash = F.lit(False)
    for name in same:
        clash = clash | (F.min(name) != F.max(name))
    nodes = rows.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("owner"), (F.count(F.lit(1)) == F.count_if("last")).alias("childless"), clash.alias("clash")
    )
    nodes = stored(nodes, "nodes")
    return nodes.drop("clash"), not nodes.filter("clash").isEmpty()


def _shard_rows(rows: DataFrame, members: DataFrame, first: int, any_turn: bool, segment: int) -> DataFrame:
    """What shards work on: (block, segment, at, digests, owner, counts), the root's rows and carried sums included."""
    mine = F.col("conv_id") == F.col("owner")
    block = F.floor(F.col("conv_id") / GROUP).alias("block")
    counted = rows.select(
        block, "segment", "conv_id", "at", "d1", "d2", "p1", "p2", "owner", F.lit(1).alias("n"), mine.cast("int").alias("child"),
        F.when(mine, 0).otherwise(F.col("chars")).alias("saved"), (mine & F.col("last") & F.col("childless")).cast("bigint").alias("leaves"),
    )
    zero = [F.lit(0).cast("bigint").alias(name) for name in ("d1", "d2", "p1", "p2")]
    is_first = F.col("conv_id") == first
    root = members.select(
        block, F.lit(0).cast("bigint").alias("segment"), "conv_id", F.lit(0).cast("bigint").alias("at"), *zero,
        F.lit(first).cast("bigint").alias("owner"), F.lit(1).alias("n"), F.lit(0).alias("child"), F.lit(0).cast("bigint").alias("saved"),
        (is_first & F.lit(not any_turn)).cast("bigint").alias("leaves"),
    )
    # Long conversations: the row before a cut stands in the next segment too, as the parent there, and has what follows.
    long_ = rows.filter(F.col("at") == segment).select("conv_id")
    cut = counted.join(long_, "conv_id", "left_semi")
    ends = cut.filter(F.col("at") % segment == segment - 1).withColumns({"n": F.lit(0), "child": F.lit(0)})
    ghosts = ends.withColumns({"segment": F.col("segment") + 1, "saved": F.lit(0).cast("bigint"), "leaves": F.lit(0).cast("bigint")})
    sums = cut.groupBy("conv_id", "segment").agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    later = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    after = sums.select("conv_id", "segment", F.sum("_s").over(later).alias("saved"), F.sum("_l").over(later).alias("leaves"))
    carried = ends.drop("saved", "leaves").join(after.filter("saved IS NOT NULL"), ["conv_id", "segment"])
    return counted.unionByName(root).unionByName(ghosts).unionByName(carried).drop("conv_id")


def _add_up(table: dict[str, np.ndarray], segment: int) -> pa.RecordBatch:
    """One shard: slots, flat arrays, sums through parent slots in depth order."""
    seg_start = table["at"] % segment == 0  # a parent lies in the segment before, or is none
    inner = ~seg_start | (table["child"] > 0)
    first, second = (np.concatenate([table[f"d{i}"], table[f"p{i}"][inner]]) for i in (1, 2))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    slots_of = SlotTable(first[new], second[new])
    size = len(slots_of)
    slot = slots_of.slots(table["d1"], table["d2"])
    parent = np.full(len(slot), -1, np.int64)
    parent[inner] = slots_of.slots(table["p1"][inner], table["p2"][inner])
    depth, owner, parent_of = (np.full(size, -1, np.int64) for _ in range(3))
    depth[parent[inner]] = table["at"][inner] - 1
    depth[slot] = table["at"]
    owner[slot] = table["owner"]
    up = ~seg_start
    parent_of[slot[up]] = parent[up]
    if (parent_of[slot[up]] != parent[up]).any() or (depth[slot] != table["at"]).any():
        raise ValueError("two prefixes share a slot")
    n, children, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
    np.add.at(n, slot, table["n"])
    np.add.at(children, parent[inner], table["child"][inner])
    np.add.at(leaves, slot, table["leaves"])
    np.add.at(saved, slot, table["saved"])
    by_depth = np.argsort(-depth, kind="stable")
    by_depth = by_depth[parent_of[by_depth] >= 0]
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):
        np.add.at(leaves, parent_of[level], leaves[level])
        np.add.at(saved, parent_of[level], saved[level])
    parent_owner = np.full(size, -1, np.int64)
    has_parent = np.zeros(size, bool)
    has_parent[slot[inner]] = True
    at_slot = np.full(size, -1, np.int64)
    at_slot[slot[inner]] = parent[inner]
    parent_owner[has_parent] = owner[at_slot[has_parent]]
    known = np.zeros(size, bool)
    known[slot] = True
    known_parent = has_parent & known[np.maximum(at_slot, 0)]
    told = (n > 0) | (children > 0) | (leaves > 0) | (saved > 0)
    columns = [
        slots_of.first, slots_of.second, depth, pa.array(owner, mask=~known), pa.array(parent_owner, mask=~known_parent), n, children, leaves, saved
    ]
    whole = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_SHARD_NAMES)
    return whole.filter(pa.array(told))


def _shards(batches: Iterator[pa.RecordBatch], segment: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    names = ["block", "segment", "at", "d1", "d2", "p1", "p2", "owner", "n", "child", "saved", "leaves"]
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = {name: np.asarray(batch.column(name)).astype(np.int64) for name in names}
        if sum(len(part["at"]) for part in held) >= shard_rows:
            # Whole runs of a block's segment only: the shard ends where the next run begins.
            tail = held[-1]
            change = np.flatnonzero((arrays["block"] != tail["block"][-1]) | (arrays["segment"] != tail["segment"][-1]))
            if len(change):
                held.append({name: values[: change[0]] for name, values in arrays.items()})
                yield _add_up({name: np.concatenate([part[name] for part in held]) for name in names}, segment)
                held, arrays = [], {name: values[change[0] :] for name, values in arrays.items()}
        held.append(arrays)
    if held:
        yield _add_up({name: np.concatenate([part[name] for part in held]) for name in names}, segment)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of rows (d1, d2, conv_id): SHA-256 of the sorted ids, comma-joined.

    Ids are sorted and joined to pieces of text over all tasks; the hash of one node then runs over its pieces in order.
    """
    order = ["d1", "d2", "conv_id"]
    schema = "d1 bigint, d2 bigint, first bigint, piece string"

    def pieces(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            key, ids, size = None, [], 0

            def close():
                if ids:
                    for column, value in zip(rows, (*key, ids[0], ",".join(map(str, ids)))):
                        column.append(value)

            for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) != key or size >= _CHUNK:
                    close()
                    key, ids, size = (a, b), [], 0
                ids.append(conv)
                size += 20
            close()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["d1", "d2", "first", "piece"])

    def digests(batches):
        key, running = None, None
        for batch in batches:
            done: list[list] = [[], [], []]

            def tell():
                if key is not None:
                    for column, value in zip(done, (*key, running.hexdigest())):
                        column.append(value)

            for a, b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (a, b) != key:
                    tell()
                    key, running = (a, b), hashlib.sha256(piece.encode())
                else:
                    running.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["d1", "d2", "ends_sha256"]
            )
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([running.hexdigest()])], names=["d1", "d2", "ends_sha256"]
            )

    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, schema)
    by_node = cut.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return by_node.mapInArrow(digests, "d1 bigint, d2 bigint, ends_sha256 string")


def prefix_nodes(turns: DataFrame, members: DataFrame, segment: int = _SEGMENT, shard_rows: int = _SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty one on.

    ``turns`` is (conv_id, at, role_key, text_key, chars) with ``at`` running from 1 in each conversation; ``members``
    has every conv_id once, those without turns included.  Columns: the smallest member ``conv_id``, ``depth``, the
    parent's ``parent_conv_id`` (null at the root), members ``n_convs``, ``n_children``, childless nodes in the subtree
    ``n_leaves``, ``saved_chars`` (over the subtree, members less one times the code points of a node's last text) and
    ``ends_sha256`` of the members that end at the node.  Without members there is no node.

    ``segment`` turns of a conversation stay together, and a shard takes whole segments until it has ``shard_rows``.
    """
    first = members.agg(F.min("conv_id")).first()[0]
    clash, salt = True, 0
    while clash:
        rows = _prefixes(turns, salt, segment)
        nodes, clash = _owned(rows)
        salt += 1
    any_turn = not rows.isEmpty()
    told = stored(rows.join(nodes, ["d1", "d2"]), "owned")
    work = _shard_rows(told, members.select("conv_id"), first if first is not None else 0, any_turn, segment)
    parts = work.repartition("block", "segment").sortWithinPartitions("block", "segment").mapInArrow(
        lambda batches: _shards(batches, segment, shard_rows), _SHARD_DDL
    )
    summed = parts.groupBy("d1", "d2").agg(
        *[F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_chars")],
    )
    turnless = members.select("conv_id").join(rows.filter("at = 1").select("conv_id"), "conv_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    ends = rows.filter("last").select("d1", "d2", "conv_id").unionByName(turnless.select(zero.alias("d1"), zero.alias("d2"), "conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    joined = summed.join(_ends_digests(ends), ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return joined.select(*_SHARD_NAMES[3:4], "depth", "parent_conv_id", *_SHARD_NAMES[5:], "ends_sha256")


def prefix_trie(conversations: DataFrame, shared_heads: bool = False) -> DataFrame:
    """``prefix_nodes`` of a conversations table (conv_id, turn, role, text); other columns are not read.

    With ``shared_heads`` each conversation is first rebuilt by ``with_shared_heads``.
    """
    turns = stored(ordered_turns(conversations), "ordered")
    ids = stored(turns.groupBy("conv_id").agg(F.max("at").alias("n")), "members")
    rebuilt = with_shared_heads(turns, ids) if shared_heads else turns
    return prefix_nodes(rebuilt, ids)
