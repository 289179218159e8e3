"""Prefix trie over conversations, built from adaptive radix trees over turn ids.

A turn (role, text) is a fixed-width big-endian id, a conversation the ids of its turns
one after the other, so conversations that share turns share a key prefix. The keys are
dealt to sorted, contiguous ranges; each range is one radix tree of bounded size.
Byte depths that are whole turns are nodes of the trie.

Only prefixes of a range's first or last key can also occur in another range: its spine.
Everything else is complete within the range. Spine nodes are summed over their ranges;
what two neighbouring ranges count twice lies on the prefix that their meeting keys
share and is taken back per boundary. So a first turn or a whole conversation that a
third of the rows share costs a few rows per range, and no task sees it whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.llm.common import if_small, sliced, stored
from marketmood.llm.radix_tree import Node, RadixTree

# Bytes of a turn's id: a hash so wide that unlike turns never meet in practice.
WIDTH = 16
# Key bytes of one radix tree.
RANGE_BYTES = 4 * 1024 * 1024
# Conversations c to c + GROUP - 1 take their first turns from the one divisible by GROUP.
GROUP = 5
HEADS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()

_TREE = {
    "kind": ("int", pa.int32()),
    "node": ("binary", pa.binary()),
    "parent": ("binary", pa.binary()),
    "conv_id": ("long", pa.int64()),
    "depth": ("long", pa.int64()),
    "parent_conv_id": ("long", pa.int64()),
    "n_convs": ("long", pa.int64()),
    "n_children": ("long", pa.int64()),
    "n_leaves": ("long", pa.int64()),
    "saved_tokens": ("long", pa.int64()),
    "ends_sha256": ("string", pa.string()),
    "first_end": ("long", pa.int64()),
    "ends": ("binary", pa.binary()),
    "first": ("binary", pa.binary()),
    "last": ("binary", pa.binary()),
    "sizes": ("array<int>", pa.list_(pa.int32())),
}
# Kinds of rows: a complete node, a range's share of a spine node, a range.
INNER, SPINE, RANGE = 0, 1, 2


def shared_turns(conv_id: int) -> int:
    """How many first turns a conversation takes from its group's first conversation."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, group, turn, id, size) of the turns, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    return conversations.filter("conv_id is not null").select(
        conv.alias("conv_id"),
        (conv - conv % GROUP).alias("group"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH).alias("id"),
        F.octet_length(text).alias("size"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): per conversation its rebuilt turns' ids and text sizes in bytes.

    The first turns of the group's first conversation are followed by the conversation's
    own from there on. One shuffle brings a group together; it is read as a stream that
    holds one conversation and the group's first turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head, head_sizes = None, b"", np.empty(0, np.int32)
        conv, parts, part_sizes = None, [], []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal group, head, head_sizes
            key, sizes = b"".join(parts), np.concatenate(part_sizes)
            own_group, conv_id = conv
            if own_group != group:
                group, head, head_sizes = own_group, b"", head_sizes[:0]
                if own_group == conv_id:
                    head, head_sizes = key[: HEADS * WIDTH], sizes[:HEADS]
            h = shared_turns(conv_id)
            rows.append((conv_id, head[: h * WIDTH] + key[h * WIDTH :], np.concatenate([head_sizes[:h], sizes[h:]])))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32())))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "key", "sizes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, convs, sizes = (batch.column(c).to_numpy() for c in ("group", "conv_id", "size"))
            ids = b"".join(batch.column("id").to_pylist())
            starts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]]).tolist()
            for s, e in zip(starts, [*starts[1:], len(convs)]):
                own = (int(groups[s]), int(convs[s]))
                if own != conv:
                    if conv is not None:
                        close()
                    conv, parts, part_sizes = own, [], []
                parts.append(ids[s * WIDTH : e * WIDTH])
                part_sizes.append(sizes[s:e])
            yield batch_of()
        if conv is not None:
            close()
            yield batch_of()

    turns = turn_rows(conversations)
    parts = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = turns.repartition(parts, "group").sortWithinPartitions("group", F.col("conv_id") != F.col("group"), "conv_id", F.asc_nulls_first("turn"), "id")
    return ordered.mapInArrow(sliced(run), "conv_id long, key binary, sizes array<int>")


def _prefix_ids(key: bytes, turns: int) -> list[bytes]:
    """The name of each prefix of 0 to ``turns`` whole turns."""
    running, names = hashlib.sha256(), []
    for d in range(turns + 1):
        names.append(running.copy().digest()[:WIDTH])
        running.update(key[d * WIDTH : (d + 1) * WIDTH])
    return names


def _shared(a: bytes, b: bytes) -> int:
    """Whole turns that two keys have in common at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    one, two = (np.frombuffer(x, np.uint8, n * WIDTH) for x in (a, b))
    return int((one != two).argmax()) // WIDTH


class RangeTrie:
    """The trie of one range of sorted keys, and its rows."""

    def __init__(self) -> None:
        self.tree, self.held = RadixTree(), 0
        self.first = self.last = b""
        self.first_sizes = self.last_sizes = ()

    def add(self, key: bytes, conv_id: int, sizes: np.ndarray) -> None:
        if not self.held:
            self.first, self.first_sizes = key, sizes
        self.last, self.last_sizes = key, sizes
        self.tree.add(key, conv_id, sizes)
        self.held += len(key) + WIDTH

    def rows(self) -> list[tuple]:
        """A row per turn-aligned depth of every path, and the range itself."""
        order = self.tree.nodes()
        members: dict[int, int] = {}
        lowest: dict[int, int] = {}
        leaves: dict[int, int] = {}
        saved: dict[int, int] = {}
        crossing: dict[int, int] = {}  # trie nodes one turn further down, at the node's end
        for node in reversed(order):
            self._sum(node, members, lowest, leaves, saved, crossing)
        names = (_prefix_ids(self.first, len(self.first) // WIDTH), _prefix_ids(self.last, len(self.last) // WIDTH))
        rows: list[tuple] = []
        # Above each node: its trie parent's smallest member, that parent's name if it is on
        # the spine, and the spine's keys that it is a prefix of.
        above: dict[int, tuple[int | None, bytes | None, tuple[int, ...]]] = {id(self.tree.root): (None, None, (0, 1))}
        for node in order:
            low, parent, along = above.pop(id(node))
            top, bottom = node.depth - len(node.path), node.depth
            key, sizes = node.first
            n, own_low = members[id(node)], lowest[id(node)]
            first_aligned = 0 if node is self.tree.root else -(-(top + 1) // WIDTH)
            aligned = range(first_aligned, bottom // WIDTH + 1)
            # Of the path's sums those of deeper turns come off as the depth grows.
            rest = saved[id(node)] + sum((n - 1) * self._size(sizes, d) for d in aligned if d * WIDTH < bottom)
            for d in aligned:
                at_end = d * WIDTH == bottom
                along = tuple(i for i in along if d == 0 or self._goes(i, key, d))
                name = names[along[0]][d] if along else None
                ends = b",".join(str(m).encode() for m in node.ends) if at_end else b""
                inner = name is None
                rows.append(
                    (
                        INNER if inner else SPINE,
                        name,
                        parent,
                        own_low,
                        d,
                        None if parent is not None else low,
                        n,
                        crossing[id(node)] if at_end or d == aligned[-1] else 1,
                        leaves[id(node)],
                        rest,
                        hashlib.sha256(ends).hexdigest() if inner else None,
                        node.ends[0] if at_end and node.ends and not inner else None,
                        ends if not inner and ends else None,
                        None,
                        None,
                        None,
                    )
                )
                rest -= (n - 1) * self._size(sizes, d) if not at_end else 0
                low, parent = own_low, name
            for child in node.children():
                above[id(child)] = (low, parent, along)
        nothing = (None,) * 12
        for at_start, key, sizes in ((True, self.first, self.first_sizes), (False, self.last, self.last_sizes)):
            rows.append((RANGE, *nothing, key if at_start else None, None if at_start else key, list(map(int, sizes))))
        return rows

    @staticmethod
    def _size(sizes, d: int) -> int:
        return int(sizes[d - 1]) if d else 0

    def _goes(self, which: int, key: bytes, d: int) -> bool:
        """Whether the first (0) or last (1) key has the d-th turn of ``key``."""
        turn = slice((d - 1) * WIDTH, d * WIDTH)
        return (self.last if which else self.first)[turn] == key[turn]

    def _sum(self, node: Node, members: dict, lowest: dict, leaves: dict, saved: dict, crossing: dict) -> None:
        """Sums at a node's end out of its children, whose paths they run up first."""
        n, low = len(node.ends), min(node.ends, default=None)
        below = total = children = 0
        for child in node.children():
            own = members[id(child)]
            n += own
            low = lowest[id(child)] if low is None else min(low, lowest[id(child)])
            below += leaves[id(child)]
            total += saved[id(child)]
            sizes = child.first[1]
            inside = range(-(-(node.depth + 1) // WIDTH), child.depth // WIDTH + 1)
            total += sum((own - 1) * self._size(sizes, d) for d in inside if d * WIDTH < child.depth)
            children += 1 if len(inside) else crossing[id(child)]
        key = id(node)
        members[key], lowest[key], crossing[key] = n, low, children
        leaves[key] = below if node.below else 1
        own_size = self._size(node.first[1], node.depth // WIDTH) if node.depth and node.depth % WIDTH == 0 else 0
        saved[key] = total + (n - 1) * own_size


def _trees(keys: DataFrame, parts: int, range_bytes: int) -> DataFrame:
    """Rows of the radix trees over the sorted ranges of ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_TREE.values())]
            return pa.RecordBatch.from_arrays(arrays, list(_TREE))

        trie = RangeTrie()
        for batch in batches:
            sizes = batch.column("sizes")
            offsets, values = sizes.offsets.to_numpy(), sizes.values.to_numpy()
            for i, (conv_id, key) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist())):
                if trie.held >= range_bytes:
                    yield batch_of(trie.rows())
                    trie = RangeTrie()
                trie.add(key, conv_id, values[offsets[i] : offsets[i + 1]])
        if trie.held:
            yield batch_of(trie.rows())

    ordered = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ordered.mapInArrow(sliced(run), ", ".join(f"{name} {kind}" for name, (kind, _) in _TREE.items()))


def _boundaries(rows: DataFrame) -> DataFrame:
    """What neighbouring ranges count twice, per node of the prefix that their meeting keys share.

    A child on that prefix is one child, its text is saved once more, and where the left
    key ends there its node is no leaf of the left range.
    """
    # One row per end of a range, so their number follows the tasks and RANGE_BYTES.
    ends = rows.filter(F.col("kind") == RANGE).select(F.coalesce("first", "last").alias("key"), F.col("first").isNotNull().alias("starts"), "order", "sizes")
    ordered = Window.orderBy("order")
    met = ends.select("starts", "key", "sizes", F.lag("key").over(ordered).alias("before")).filter("starts and before is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, before, sizes in zip(*(batch.column(c).to_pylist() for c in ("key", "before", "sizes"))):
                depth = _shared(key, before)
                leaf = -1 if depth * WIDTH == len(before) else 0
                chain = np.r_[0, np.array(sizes[:depth], np.int64)]
                twice = chain[::-1].cumsum()[::-1].tolist()
                out += [(name, -1 if d < depth else 0, leaf, twice[d]) for d, name in enumerate(_prefix_ids(key, depth))]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["node", "n_children", "n_leaves", "saved_tokens"])

    return met.select("key", "before", "sizes").mapInArrow(sliced(run), "node binary, n_children long, n_leaves long, saved_tokens long")


def _digests(shares: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the spine nodes: their ranges' joined ids, hashed as a stream in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out = []
            for own, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if own != node:
                    if node is not None:
                        out.append((node, running.hexdigest()))
                    node, running = own, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ends)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])

    parts = max(2, int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = shares.filter("ends is not null").select("node", "first_end", "ends")
    return chunks.repartition(parts, "node").sortWithinPartitions("node", "first_end").mapInArrow(sliced(run), "node binary, ends_sha256 string")


def prefix_trie(keys: DataFrame, parts: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The trie's nodes, from (conv_id, key, sizes) rows of distinct ids.

    Per node: conv_id, its smallest member; depth; parent_conv_id, the parent's conv_id
    (root: null); n_convs; n_children; n_leaves, the childless nodes of its subtree;
    saved_tokens, the sum over its subtree of (n_convs - 1) times the bytes of a node's
    last text; ends_sha256, of the decimal ids of the members that end there, ascending
    and joined by commas. No keys give no nodes, not even a root.
    """
    spark = keys.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = stored(keys, "keys")
    # A range's two rows stand together: their order is that of the keys, equal keys by the range's task.
    trees = _trees(kept, parts, range_bytes).withColumn("order", F.monotonically_increasing_id())
    rows = stored(trees, "trees")
    shares = rows.filter(F.col("kind") == SPINE)
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    twice = _boundaries(rows).withColumn("n_convs", F.lit(0).cast("long"))
    plain = shares.select("node", "parent", "conv_id", "depth", *sums).unionByName(twice, allowMissingColumns=True)
    spine = plain.groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in sums))
    spine = spine.join(_digests(shares), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    spine = stored(spine, "spine")
    parents = if_small(spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv")))
    inner = rows.filter(F.col("kind") == INNER)
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    nodes = inner.select("parent", *columns).unionByName(spine.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *columns))
    return nodes.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_conv")).select(*columns)


def conversation_trie(conversations: DataFrame, parts: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The prefix trie of all rebuilt conversations; columns as in ``prefix_trie``.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns
    are ordered by turn, null first; turns of equal number stand in the order of their
    ids, so repeated rows are repeated turns. A null role or text counts as empty. Rows
    with a null conv_id belong to no conversation. Texts of any length are hashed whole.
    A conversation's ids, 20 bytes a turn, must fit into a task.
    """
    return prefix_trie(rebuilt(conversations), parts, range_bytes)
