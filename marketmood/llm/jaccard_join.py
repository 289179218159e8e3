"""N-gram Jaccard join: documents linked by the Jaccard similarity of their shingle sets.

A size-aware heavy-light join over the distinct sets (documents of equal sets form one
node, so copies are never paired). Sets that link share PERCENT of the larger one. In
any fixed order of all shingles they therefore share a key within their first shingles:

* a small set is enumerated: its keys are the fixed-size subsets (pairs) of its prefix;
* a large set has its single prefix shingles as keys, whose inverted lists are scanned;
* the boundary between them is where enumerating costs more than scanning, from the
  list lengths measured; sets near it have both kinds of keys.

A set's prefix is long enough for a linked set to share several of its shingles, in
proportion to its size; pairs that share fewer are dropped by their counts. A short list
gives all its pairs; a long one only links its
members to a leader, the document with the smallest id and so often the original of its
near copies. The order has the shingles last
that the pass over all sets finds frequent, such as those of passages that unlike
documents share. Shingles of long lists that still hold several components are moved
behind them, and the sets concerned are joined again under the new order: two sets whose
link is still missed share all their prefix's common shingles in such open lists, so a
set that stands in fewer of them than that is left out. Any order is
valid, so no link is lost. Lists that are open after that are gone through in waves: the
first members of a list, LEADERS times as many in each wave, are compared with its members
of other components by their bitmaps; what they link is one component before the next wave, and a list of one
component is closed. So a large group of near copies costs a multiple of its size in
pairs, and a list of unlike documents ends with all its pairs tried. Pairs pass a bitmap
bound on the symmetric difference and are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from marketmood.llm.common import BROADCAST_BYTES, SHINGLE_WORDS, if_small, sliced, size_of, stored, window_hashes
from marketmood.llm.components import components
from marketmood.llm.wordscan import WordScanner

PERCENT = 75
# A list up to this long gives all its pairs, a longer one links to its leader.
SHORT_LIST = 24
# Rounds with shingles moved to the end, before the waves.
ROUNDS = 2
# Leaders of a list in the first wave, and how many times as many in each further one.
LEADERS = 16
# Shingles counted together by a task, and how often one stands there to be reported.
COUNTED = 1 << 20
REPORTED = 3
# Shingles that can be moved, the heaviest first; 8 bytes each, held by every task.
MOVED = 1_000_000
# Sizes at which enumerating pairs is considered.
LARGEST_SMALL = 64
# Prefixes reach so far that one in this many of a set's shingles is shared within them.
SHARED_PART = 20
# Bits of a set's bitmap: a power of two, at least this and at least the set's size.
LEAST_BITS = 1024
# The place of a document without an id.
LAST = (1 << 63) - 1
# Candidate pairs, and documents, taken at a time.
BLOCK = 1 << 17
DOCUMENTS = 1000
# Members verified against one copy of their leader's text.
MEMBERS = 64


def document_set(scanner: WordScanner, text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the text with A-Z lower-cased."""
    hashes = scanner.scan((text or b"").lower())[0]
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(SHINGLE_WORDS, len(hashes))))


def set_id(shingles: np.ndarray) -> int:
    """The node of a set: a signed 64-bit hash of all its shingles."""
    raw = xxh3_64_intdigest(shingles.tobytes())
    return raw - (1 << 64) if raw >> 63 else raw


def prefix_length(n: int, shared: int = 1, percent: int = PERCENT) -> int:
    """First shingles of a set of n within which a linked set shares ``shared`` of them."""
    return n - -(-percent * n // 100) + shared


def least_shared(n):
    """Shingles that a large set of n and a linked one share within their prefixes."""
    return 1 + n // SHARED_PART


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bucket; bits that differ bound the symmetric difference."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer bitmap is folded onto the shorter."""
    long, short = np.frombuffer(max(a, b, key=len), np.uint64), np.frombuffer(min(a, b, key=len), np.uint64)
    if len(long) > len(short):
        long = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(long ^ short).sum())


def _signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, node of every row; bitmap, and prefix if small, where a task first meets a set.

    Rows with a count hold a shingle (as node) that is frequent among a task's sets:
    they only serve the order of shingles.
    """
    schema = "doc_id long, n long, node long, bits binary, prefix array<long>, count long"
    names = ["doc_id", "n", "node", "bits", "prefix", "count"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def frequent(held: list[np.ndarray]) -> list[tuple]:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= REPORTED
        return [(None, 0, t, None, None, c) for t, c in zip(found[often].view(np.int64).tolist(), counts[often].tolist())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, met, held, size = WordScanner(), set(), [], 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = document_set(scanner, text)
                key = set_id(own) if len(own) else None
                if key is None or key in met:
                    rows.append((doc_id, len(own), key, None, None, None))
                    continue
                met.add(key)
                small = own[: prefix_length(len(own), 2, percent)].view(np.int64) if len(own) <= LARGEST_SMALL else None
                rows.append((doc_id, len(own), key, bitmap(own), small, None))
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    rows += frequent(held)
                    held, size = [], 0
            yield batch_of(rows)
        if held:
            yield batch_of(frequent(held))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sliced(run), schema)


def _boundary(signatures: DataFrame, percent: int) -> int:
    """The largest set size at which pairs of the prefix cost no more than scanning its lists."""
    small = signatures.filter(f"prefix is not null and n <= {LARGEST_SMALL}")
    lists = small.select(F.explode("prefix").alias("key")).groupBy("key").count()
    rows, met = lists.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    mean = met / rows if rows else 1.0
    best = 0
    for n in range(2, LARGEST_SMALL + 1):
        p = prefix_length(n, 2, percent)
        if p * (p - 1) / 2 <= (p - 1) * (1 + mean):
            best = n
    return best


def _key_batches(batches: Iterator[pa.RecordBatch], boundary: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, place, node, n, label) of sets with a prefix: keys are pairs for small sets, shingles for large ones.

    place orders a list's members. A null label stands for the node itself.
    """
    with_pairs = boundary * 100 // percent
    for batch in batches:
        keys, places, nodes, sizes, labels = [], [], [], [], []
        offsets = batch.column("prefix").offsets.to_numpy()
        values = batch.column("prefix").values.to_numpy().view(np.uint64)
        for i, (place, node, n, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "node", "n", "label")))):
            own = values[offsets[i] : offsets[i + 1]]
            parts = []
            if n > boundary:
                parts.append(own[: prefix_length(n, least_shared(n), percent)])
            if 2 <= n <= with_pairs:
                own = own[: prefix_length(n, 2, percent)]
                first, second = np.triu_indices(len(own), 1)
                low, high = np.minimum(own[first], own[second]), np.maximum(own[first], own[second])
                with np.errstate(over="ignore"):
                    parts.append(low * np.uint64(0x9E3779B97F4A7C15) ^ high)
            count = sum(map(len, parts))
            keys += parts
            places.append(np.full(count, place, np.int64))
            nodes.append(np.full(count, node, np.int64))
            sizes.append(np.full(count, n, np.int64))
            labels.append(np.full(count, node if label is None else label, np.int64))
        columns = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (keys, places, nodes, sizes, labels)]
        arrays = [pa.array(c) for c in columns[:4]] + [pa.array(columns[4], mask=columns[4] == columns[2])]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "place", "node", "n", "label"])


def _scan_lists(keys: DataFrame, boundary: int, limit: int, percent: int) -> DataFrame:
    """Candidates of all inverted lists: kind 0, the pair (a, b); kind 1, member b of long list a.

    need is how many keys the pair shares at least if it links: 1 where a set of it has
    pairs as keys.

    Lists are runs of sorted rows and are read as a stream: one of up to ``limit`` rows is
    held, of a longer one only the leader.
    """
    names = ["kind", "a", "b", "need"]
    with_pairs = boundary * 100 // percent

    def need(sizes: np.ndarray) -> np.ndarray:
        return np.where(sizes <= with_pairs, 1, least_shared(sizes)).astype(np.int32)

    def pairs(nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        """All pairs of different labels that pass the size filter, in blocks."""
        order = np.argsort(labels, kind="stable")
        nodes, sizes, labels = nodes[order], sizes[order], labels[order]
        stops = np.searchsorted(labels, labels, "right")
        at = 0
        while at < len(nodes) and stops[at] < len(nodes):
            # Members at..end of one label, each with all members of later labels.
            rest = len(nodes) - int(stops[at])
            end = min(int(stops[at]), at + max(1, BLOCK // rest))
            first = np.repeat(np.arange(at, end), rest)
            second = np.tile(np.arange(int(stops[at]), len(nodes)), end - at)
            low, high = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
            fits = high * percent <= low * 100
            yield 0, nodes[first[fits]], nodes[second[fits]], need(low[fits])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        long_key, leader, leader_size = None, 0, 0

        def star(key: int, nodes: np.ndarray, sizes: np.ndarray, out: list) -> None:
            """Members of a long list joined to the list's first member."""
            nonlocal long_key, leader, leader_size
            if long_key != key:
                long_key, leader, leader_size = key, int(nodes[0]), int(sizes[0])
            low, high = np.minimum(sizes, leader_size), np.maximum(sizes, leader_size)
            fits = (high * percent <= low * 100) & (nodes != leader)
            own = nodes[fits]
            out.append((0, np.full(len(own), leader, np.int64), own, need(low[fits])))
            out.append((1, np.full(len(nodes), key, np.int64), nodes, np.zeros(len(nodes), np.int32)))

        def emit(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                kind = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out])
                a, b, least = (np.concatenate([x[i] for x in out]) for i in (1, 2, 3))
                for i in range(0, len(a), BLOCK):
                    j = i + BLOCK
                    yield pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (kind, a, b, least)], names)

        def lists(key: np.ndarray, node: np.ndarray, n: np.ndarray, label: np.ndarray, last: bool) -> Iterator[tuple]:
            """Out of sorted rows, the candidates of each complete list; keeps the rest."""
            nonlocal held
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(key)].astype(np.int64)
            out: list = []
            end_held = 0 if last else 1
            lengths = ends - starts
            whole = len(starts) - end_held
            double = starts[:whole][lengths[:whole] == 2]
            low, high = np.minimum(n[double], n[double + 1]), np.maximum(n[double], n[double + 1])
            fits = (high * percent <= low * 100) & (label[double] != label[double + 1])
            double, low = double[fits], low[fits]
            if len(double):
                out.append((0, node[double], node[double + 1], need(low)))
            for i in np.flatnonzero(lengths[:whole] > 2).tolist():
                s, e = int(starts[i]), int(ends[i])
                if e - s > limit:
                    star(int(key[s]), node[s:e], n[s:e], out)
                else:
                    made = 0
                    for part in pairs(node[s:e], n[s:e], label[s:e]):
                        out.append(part)
                        made += len(part[1])
                        if made >= BLOCK:
                            yield from emit(out)
                            out, made = [], 0
            held = [x[starts[whole] :] if 0 <= whole < len(starts) else x[:0] for x in (key, node, n, label)]
            # The list that goes on: once it is long, its members need not be held.
            if len(held[0]) > limit:
                star(int(held[0][0]), held[1], held[2], out)
                held = [x[-1:] for x in held]
            yield from emit(out)

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "node", "n")]
            rows.append(pc.coalesce(batch.column("label"), batch.column("node")).to_numpy())
            if not len(rows[0]):
                continue
            if long_key is not None and len(held[0]) == 1 and held[0][0] == long_key:
                # One row is kept of a long list to tell that it goes on; it is not reported again.
                stop = int(np.searchsorted(rows[0], long_key, "right")) if rows[0][0] == long_key else 0
                if stop:
                    new = rows[1][:stop] != np.r_[held[1], rows[1][: stop - 1]]
                    out: list = []
                    if new.any():
                        star(long_key, rows[1][:stop][new], rows[2][:stop][new], out)
                    yield from emit(out)
                if stop == len(rows[0]):
                    held = [x[-1:] for x in rows]
                    continue
                held = [x[:0] for x in held]
                rows = [x[stop:] for x in rows]
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            yield from lists(*(x[new] for x in rows), last=False)
        if long_key is None or not len(held[0]) or held[0][0] != long_key:
            yield from lists(*held, last=True)

    parts = max(2, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartition(parts, "key").sortWithinPartitions("key", "place", "node").drop("place")
    return ordered.mapInArrow(sliced(run), "kind int, a long, b long, need int")


def _folded(bits: bytes) -> np.ndarray:
    """A bitmap of LEAST_BITS, to which longer ones are folded; differences never grow."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, LEAST_BITS // 64), axis=0)


def _scan_wave(members: DataFrame, placed: DataFrame, leaders: int, percent: int) -> DataFrame:
    """The pairs (a, b) of each list's first ``leaders`` members and its members of other
    labels that their bitmaps do not rule out.

    ``members`` are (key, node), ``placed`` their (node, place, n, label, bits). Few
    of these go to every task, so that only (key, node) is dealt out. Lists are read as a stream that
    holds the leaders alone; the pairs are compared in blocks and few leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *rows = (batch.column(c).to_numpy() for c in ("key", "node", "n", "label"))
            rows.append(np.stack([_folded(b) for b in batch.column("bits").to_pylist()]))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
            for s, e in zip(starts, [*starts[1:], len(key)]):
                own = [x[s:e] for x in rows]
                if key[s] != here:
                    here, first = key[s], [x[:0] for x in rows]
                first = [np.concatenate([f, x[: leaders - len(f)]]) for f, x in zip(first, own)]
                nodes, sizes, labels, words = own
                step = max(1, BLOCK // len(nodes))
                for at in range(0, len(first[0]), step):
                    node, n, label, bits = (f[at : at + step] for f in first)
                    low, high = np.minimum(sizes, n[:, None]), np.maximum(sizes, n[:, None])
                    which, other = np.nonzero((high * percent <= low * 100) & (labels != label[:, None]))
                    differ = np.bitwise_count(bits[which] ^ words[other]).sum(axis=1, dtype=np.int64)
                    fits = (100 + percent) * differ <= (100 - percent) * (n[which] + sizes[other])
                    a, b = node[which[fits]], nodes[other[fits]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    parts = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if size_of(placed) <= BROADCAST_BYTES:
        dealt = members.repartition(parts, "key").join(F.broadcast(placed), "node")
    else:
        dealt = members.join(placed, "node").repartition(parts, "key")
    ordered = dealt.select("key", "place", "node", "n", "label", "bits").sortWithinPartitions("key", "place", "node")
    return ordered.mapInArrow(sliced(run), "a long, b long").distinct()


def _shared_enough(found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose counted keys, with those of long lists that both may share, are enough."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = stored(found.filter("kind = 0").groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")), "shared")
    single = pairs.filter("shared >= need").select("a", "b")
    long = if_small(stored(found.filter("kind = 1").groupBy("b").agg(F.count(F.lit(1)).alias("long")), "long"))
    rest = (
        pairs.filter("shared < need")
        .join(long.select(F.col("b").alias("a"), F.col("long").alias("long_a")), "a")
        .join(long.select("b", F.col("long").alias("long_b")), "b")
        .filter("shared >= need - least(long_a, long_b)")
    )
    return single.unionAll(rest.select("a", "b"))


def _only(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Of more ``nodes`` than a broadcast takes those that ``names`` (node) holds, without a shuffle
    of all nodes; all of them if the names are too many, too."""
    if size_of(nodes) <= BROADCAST_BYTES:
        return nodes
    names = stored(names.distinct(), "named")
    return stored(nodes.join(F.broadcast(names), "node", "left_semi"), "named-nodes") if size_of(names) <= BROADCAST_BYTES else nodes


def _close_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (written) whose bitmaps do not rule a link out, with both documents."""
    small = if_small(_only(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    one = small.select(F.col("node").alias("a"), F.col("doc_id").alias("doc_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = small.select(F.col("node").alias("b"), F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            differ = np.array([least_difference(a, b) for a, b in bits], np.int64)
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            # percent * (total + d) <= 100 * (total - d) for the symmetric difference d.
            fits = (100 + percent) * differ <= (100 - percent) * total
            yield batch.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(fits))

    return both.mapInArrow(sliced(run), "a long, b long, doc_a long, doc_b long")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (with doc_id and node) and their text, once or more often.

    By the id; nodes that have only rows without an id are found by their set.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    named = texts.join(if_small(wanted), "doc_id").select(*wanted.columns, "text")
    nameless = wanted.filter("doc_id is null")
    if nameless.limit(1).count() == 0:
        return named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, met = WordScanner(), set()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own = document_set(scanner, text)
                key = set_id(own) if len(own) else None
                if key is not None and key not in met:
                    met.add(key)
                    rows.append((key, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "text"])

    by_set = texts.filter("doc_id is null").select("text").mapInArrow(sliced(run), "node long, text binary")
    return named.unionByName(by_set.join(if_small(nameless), "node").select(*wanted.columns, "text"))


def _verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the exact similarity of their texts' sets.

    A member's text meets one copy of its leader's; a leader of many members is copied
    once per MEMBERS of them, so no group is larger.
    """
    groups = pairs.groupBy("a", "doc_a").agg(F.count(F.lit(1)).alias("members"))
    splits = F.ceil(F.col("members") / MEMBERS).cast("int")
    leaders = groups.select("a", F.col("doc_a").alias("doc_id"), F.explode(F.sequence(F.lit(0), splits - 1)).alias("split"), F.col("a").alias("node"), F.lit(0).alias("kind"))
    sized = pairs.join(if_small(stored(groups.select("a", splits.alias("splits")), "leaders")), "a")
    members = sized.select("a", F.col("doc_b").alias("doc_id"), F.pmod(F.xxhash64("b"), F.col("splits")).cast("int").alias("split"), F.col("b").alias("node"), F.lit(1).alias("kind"))
    wanted = stored(leaders.unionByName(members), "wanted")
    rows = _with_texts(docs, wanted).select("a", "split", "kind", "node", "text")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "a", "split").sortWithinPartitions("a", "split", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, group, leader = WordScanner(), None, None
        for batch in batches:
            found = []
            for a, split, kind, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "split", "kind", "node", "text"))):
                if (a, split) != group:
                    group, leader = (a, split), None
                own = document_set(scanner, text)
                if not len(own) or set_id(own) != node:
                    continue  # another text under the same id
                if kind == 0:
                    leader = own
                elif leader is not None:
                    at = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
                    shared = int((leader[at] == own).sum())
                    if 100 * shared >= percent * (len(leader) + len(own) - shared):
                        found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(sliced(run), "a long, b long").distinct()


def _list_rows(docs: DataFrame, wanted: DataFrame | None, moved: np.ndarray, boundary: int, percent: int) -> DataFrame:
    """(key, place, node, n, label) under the order that has the moved shingles last.

    Of all sets, where a task first meets them, or of the wanted (doc_id, node, label).
    """
    chosen = wanted is not None
    names = ["place", "node", "n", "label", "prefix"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, met = WordScanner(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                rows = []
                nodes, labels = (batch.column(c).to_pylist() if chosen else [None] * batch.num_rows for c in ("node", "label"))
                for place, node, label, text in zip(batch.column("doc_id").to_pylist(), nodes, labels, batch.column("text").to_pylist()):
                    own = document_set(scanner, text)
                    found = set_id(own) if len(own) else None
                    if found is None or found in met or chosen and found != node:
                        continue
                    met.add(found)
                    late = np.zeros(len(own), bool)
                    if len(moved):
                        late = moved[np.minimum(np.searchsorted(moved, own), len(moved) - 1)] == own
                    own = np.concatenate([own[~late], own[late]])
                    length = prefix_length(len(own), max(2, least_shared(len(own))), percent)
                    rows.append((LAST if place is None else place, found, len(own), label, own[:length].view(np.int64)))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _key_batches(prefixes(batches), boundary, percent)

    if chosen:
        texts = _with_texts(docs, wanted).select("doc_id", "node", "label", "text")
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(sliced(run), "key long, place long, node long, n long, label long")


def _heaviest(lists: DataFrame) -> np.ndarray:
    """The keys of the MOVED longest lists, sorted."""
    kept = lists.orderBy(F.desc("n"), "key").limit(MOVED).select("key")
    return np.sort(np.array([r["key"] for r in kept.toLocalIterator()], np.int64).view(np.uint64))


def _open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n) of the lists that hold several components; nodes without a label are their own."""
    named = members.join(if_small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    return sums.filter("low < high").select("key", "n")


def _open_members(members: DataFrame, labels: DataFrame, nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """The (key, node) of open lists that can still hold a link.

    Two sets whose link is not found share long lists only, all of them open and as many as
    the smaller set, which has ``percent`` of the larger one's size at least, needs.
    """
    lists = stored(_open_lists(members, labels), "open")
    inside = members.join(if_small(lists.select("key")), "key", "left_semi")
    smaller = F.ceil(F.col("n") * percent / 100)
    need = F.when(smaller <= boundary * 100 // percent, 1).otherwise(1 + F.floor(smaller / SHARED_PART))
    counts = inside.groupBy("node").agg(F.count(F.lit(1)).alias("lists"))
    enough = counts.join(if_small(nodes.select("node", "n")), "node").filter(F.col("lists") >= need).select("node")
    return inside.join(if_small(stored(enough, "enough")), "node", "left_semi").select("key", "node")


def _components(docs: DataFrame, percent: int, rounds: int, short_list: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, nodes, labels): a row per document, per set, and per set that has a link."""
    found = stored(_signatures(docs, percent), "sets")
    signatures = found.filter("count is null")
    nodes = stored(
        signatures.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits")),
        "nodes",
    )
    frequent = found.filter("count is not null").groupBy(F.col("node").alias("key")).agg(F.sum("count").alias("n"))
    moved = _heaviest(frequent.filter(F.col("n") > short_list))
    boundary = _boundary(signatures, percent)
    edges: list[DataFrame] = []
    tried: list[DataFrame] = []
    labels = wanted = members = None

    def link(pairs: DataFrame) -> DataFrame:
        """Verify the pairs not yet tried; labels of all links so far."""
        if tried:
            pairs = stored(pairs.join(reduce(DataFrame.unionAll, tried), ["a", "b"], "left_anti"), "untried")
        close = stored(_close_enough(pairs, nodes, percent), "close")
        tried.append(close.select("a", "b"))
        new = stored(_verify(close, docs, percent), "edges")
        edges.append(new)
        if labels is not None and new.limit(1).count() == 0:
            return labels
        return components(reduce(DataFrame.unionAll, edges))

    for turn in range(rounds):
        lists = stored(_scan_lists(_list_rows(docs, wanted, moved, boundary, percent), boundary, short_list, percent), "lists")
        labels = link(stored(_shared_enough(lists), "pairs"))
        members = lists.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"))
        members = stored(_open_members(members, labels, nodes, boundary, percent), "members")
        open_lists = stored(_open_lists(members, labels), "open")
        new = _heaviest(open_lists)
        if not len(new):
            return signatures, nodes, labels
        if turn == rounds - 1:
            break
        moved = np.union1d(moved, new)
        open_nodes = members.join(if_small(open_lists.select("key")), "key", "left_semi").select("node").distinct()
        wanted = open_nodes.join(nodes.select("node", "doc_id"), "node").join(if_small(labels), "node", "left")
        wanted = stored(wanted.select("doc_id", "node", "label"), "open-nodes")

    placed = nodes.select("node", "n", F.coalesce("doc_id", F.lit(LAST)).alias("place"), "bits")
    leaders = LEADERS
    while True:
        longest = open_lists.agg(F.max("n")).first()[0]
        if longest is None:
            return signatures, nodes, labels
        inside = members.join(if_small(open_lists.select("key")), "key", "left_semi")
        named = _only(placed, inside.select("node")).join(if_small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        linked = link(stored(_scan_wave(inside, named, leaders, percent), "wave"))
        if leaders >= longest:
            return signatures, nodes, linked
        if linked is not labels:
            labels = linked
            members = stored(_open_members(inside, labels, nodes, boundary, percent), "members")
            open_lists = stored(_open_lists(members, labels), "open")
        leaders *= LEADERS


def link_documents(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, short_list: int = SHORT_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Two documents link when 100 * shared >= percent * united of their sets of distinct
    5-word shingles (A-Z lower-cased; with fewer words the whole sequence is one
    shingle). component_id is the smallest doc_id reachable by links, itself included.
    A null or empty text, or one without words, has n_shingles 0 and links with nothing.
    Rows of equal sets, repeated rows too, are one node. A null id never is a
    component_id: such a row has the smallest other id of its component, else null. Rows
    that repeat an id with other texts are judged by their texts. Other columns are not
    read.
    """
    signatures, nodes, labels = _components(docs, percent, rounds, short_list)
    lowest = labels.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(lowest, "label").select("node", "component_id")
    per_node = nodes.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    per_node = if_small(stored(per_node, "components"))
    rows = signatures.select("doc_id", F.col("n").alias("n_shingles"), "node")
    # Texts without words have no node and would all meet in one task.
    alone = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.filter("node is not null").join(per_node, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one row.

    The row with the smallest id stays, of equal ids with several texts the one of the
    smallest set name, of equal rows one. Rows with a null id are judged like the others
    and come last. Texts without words are in no component and all stay.
    """
    signatures, nodes, labels = _components(docs, percent, ROUNDS, SHORT_LIST)
    rows = signatures.filter("node is not null").select("doc_id", "node")
    label = F.coalesce("label", "node").alias("label")
    # Per component its first set: no id comes after every id.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    chosen = nodes.join(labels, "node", "left").select(label, place.alias("place")).groupBy("label").agg(F.min("place").alias("place"))
    chosen = stored(chosen.select(F.col("place.node").alias("node"), F.col("place.doc_id").alias("doc_id")), "chosen")
    # Ids that stand in one row are judged by the id alone, without a further look at the texts.
    ids = stored(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("node")), "ids")
    once = ids.filter("rows = 1").select("doc_id", "node")
    gone = once.join(chosen.select("node", F.col("doc_id").alias("first")), "node", "left").filter("first is null or first <> doc_id").select("doc_id")
    again = stored(ids.filter("rows > 1").select("doc_id"), "again")
    kept = docs.join(if_small(stored(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
    nameless = rows.filter("doc_id is null").limit(1).count() > 0
    if not nameless and again.limit(1).count() == 0:
        return kept
    plain = kept.filter("doc_id is not null").join(if_small(again), "doc_id", "left_anti").select(*docs.columns)
    open_rows = kept.filter("doc_id is not null").join(if_small(again), "doc_id", "left_semi").unionByName(kept.filter("doc_id is null"))
    return plain.unionByName(_first_of_sets(open_rows.select(*docs.columns), chosen))


def _first_of_sets(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of rows that their id does not tell apart, one per chosen (node, doc_id), and all without words."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            texts = dict(zip(columns, batch.column("own").flatten()))["text"].cast(pa.binary())
            sets = [document_set(scanner, t) for t in texts.to_pylist()]
            nodes = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, batch.column("own")], ["node", "own"])

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("own", rows.schema)])
    named = rows.select(F.struct(*columns).alias("own")).mapInArrow(sliced(run), schema)
    named = stored(named, "named")
    wordless = named.filter("node is null").select("own.*")
    met = named.filter("node is not null").join(if_small(chosen.withColumnRenamed("doc_id", "first")), "node")
    met = met.filter(F.col("own.doc_id").cast("long").eqNullSafe(F.col("first")))
    # Rows of one set and id are alike but for other columns: the first by their text stays.
    first = met.groupBy("node").agg(F.min_by("own", F.struct("own.text", F.xxhash64("own"))).alias("own")).select("own.*")
    return wordless.unionByName(first).select(*columns)
