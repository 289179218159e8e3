"""Ranked lexical search: Block-Max MaxScore over inverted indexes of document shards.

``build_index`` cuts the documents into shards as they are read and writes an inverted
index of each: per term its postings in blocks of compressed document gaps and counts,
with each block's highest count and shortest document. Those two bound a document's
score for any corpus totals, so an index stays valid when shards are added.

``search`` sums the totals over the shards, reads only the lists of the items' terms, and
goes through each shard once for all items. Terms with the highest bounds are essential:
their lists are read whole, until what the rest can add is less than the k-th score so
far. The other lists are only looked up for documents still in question, and only in
blocks whose maximum lets the document reach that score; the rest are never
decompressed. A task keeps one heap per item over its shards; the heaps are merged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.llm.common import sliced, stored

K = 20
# Words of a shard, and postings of a block.
SHARD_WORDS = 1 << 22
BLOCK = 128
# Text of the items searched for together; their terms are held by every task.
ITEM_BYTES = 4 * 1024 * 1024
# Essential lists read between two looks at the k-th score.
LOOK = 4
# Fixed values of the score: counts weigh 1000 * tf to 12 * m, with m = 75 + 25 * n * N div L.
TF_SCALE, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_BASE, LENGTH_PART = 1_000_000_000, 1000, 12, 75, 25

_INDEX = "shard long, term binary, df long, words long, postings binary"
# Letters, digits and all bytes of code points beyond ASCII, with A-Z lower-cased; else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers, seven bits a byte, low bits first; and where each one starts."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        width += more
    starts = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for i in range(int(width.max(initial=0))):
        own = width > i
        low = (values[own] >> np.uint64(7 * i)) & np.uint64(127)
        out[starts[own] + i] = low + np.where(width[own] > i + 1, 128, 0).astype(np.uint64)
    return out, starts


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers of ``packed``."""
    if not len(raw):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, raw[:-1] < 128])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


class ShardBuilder:
    """The inverted index of documents added one by one."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.docs: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.docs.append(doc_id)
        self.terms.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.words += len(words)

    def rows(self, shard: int) -> Iterator[tuple]:
        """(shard, term, df, words, postings) per term; the empty term lists the documents."""
        lengths = np.array([len(t) for t in self.terms], np.int64)
        n = len(lengths)
        known = np.array([d is not None for d in self.docs])
        ids = np.array([d or 0 for d in self.docs], np.int64)
        yield shard, b"", n, int(lengths.sum()), lengths.astype("<u4").tobytes() + ids.astype("<i8").tobytes() + np.packbits(known).tobytes()
        keys, counts = np.unique(np.concatenate(self.terms) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = keys // n, keys % n
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        df = np.diff(np.r_[first, len(term)])
        place = np.arange(len(term)) - np.repeat(first, df)
        blocks = np.flatnonzero(place % BLOCK == 0)
        gaps = np.r_[0, np.diff(doc)]
        gaps[blocks] = 0
        raw, starts = packed(np.c_[gaps, counts].ravel())
        ends = np.r_[starts[2 * blocks][1:], len(raw)]
        most, least = np.maximum.reduceat(counts, blocks), np.minimum.reduceat(lengths[doc], blocks)
        sums = np.add.reduceat(counts, first)
        own = np.r_[np.searchsorted(blocks, first), len(blocks)]
        raw = raw.tobytes()
        before = np.r_[0, ends]
        for i, name in enumerate(self.ids):
            a, b = own[i], own[i + 1]
            start = before[a]
            head = np.concatenate([[b - a], doc[blocks[a:b]], most[a:b], least[a:b], ends[a:b] - start]).astype("<u4")
            yield shard, name, int(df[i]), int(sums[i]), head.tobytes() + raw[start : before[b]]


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all documents with a term: (shard, term, df, words, postings), written.

    Each row of ``docs`` (doc_id, text) is a document of its own, whatever its id. One
    pass, nothing is shuffled. A shard takes documents in the order of reading up to
    ``shard_words`` words; only a longer document makes a longer shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32

        def close() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in builder.rows(shard):
                rows.append(row)
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "term", "df", "words", "postings"])

        builder = ShardBuilder()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                if builder.docs and builder.words + len(words) > shard_words:
                    yield from close()
                    builder, shard = ShardBuilder(), shard + 1
                builder.add(doc_id, words)
        if builder.docs:
            yield from close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(source.mapInArrow(sliced(run), _INDEX), "index")


class Totals:
    """Documents and words of the corpus, and a part's score out of its count and length."""

    def __init__(self, n_docs: int, n_words: int):
        self.n_docs, self.n_words = n_docs, n_words

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def part(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = LENGTH_BASE + LENGTH_PART * length * self.n_docs // self.n_words
        return TF_SCALE * tf // (TF_WEIGHT * tf + LENGTH_WEIGHT * m)


class Postings:
    """One term's list in a shard; blocks are decompressed when asked for."""

    def __init__(self, raw: bytes, totals: Totals):
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        head = np.frombuffer(raw, "<u4", 4 * n, 4).astype(np.int64).reshape(4, n)
        self.first, most, least, self.ends = head
        self.starts = np.r_[0, self.ends[:-1]]
        self.data = np.frombuffer(raw, np.uint8, offset=4 + 16 * n)
        self.bounds = totals.part(most, least)
        self.bound = int(self.bounds.max())

    def read(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of the blocks, of all by default."""
        if blocks is None:
            raw, first = self.data, self.first
            sizes = self.ends - self.starts
        else:
            first, sizes = self.first[blocks], self.ends[blocks] - self.starts[blocks]
            at = np.repeat(self.starts[blocks] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            raw = self.data[at]
        numbers = unpacked(raw).reshape(-1, 2)
        # Values that start before a block's first byte, halved, are the postings before it.
        begun = np.r_[0, np.cumsum(raw < 128)]
        begins = begun[np.cumsum(sizes) - sizes] // 2
        gaps = np.cumsum(numbers[:, 0])
        base = np.repeat(first - gaps[begins], np.diff(np.r_[begins, len(numbers)]))
        return gaps + base, numbers[:, 1]


class Best:
    """The k highest (score, doc_id) of an item so far; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nameless = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document must score to be taken, at least."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        scores, ids, nameless = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.nameless, nameless]
        order = np.lexsort((ids, nameless, -scores))[: self.k]
        self.scores, self.ids, self.nameless = scores[order], ids[order], nameless[order]


class Shard:
    """A shard's documents and the lists of the terms asked for."""

    def __init__(self, n: int, raw: bytes, totals: Totals):
        self.totals = totals
        self.lengths = np.frombuffer(raw, "<u4", n).astype(np.int64)
        self.ids = np.frombuffer(raw, "<i8", n, 4 * n)
        self.nameless = ~np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool)
        self.lists: dict[bytes, Postings] = {}

    def search(self, weights: dict[bytes, int], best: Best) -> int:
        """Add the shard's best documents for a weighted query; returns the blocks it read."""
        own = [(w * self.lists[t].bound, w, self.lists[t]) for t, w in weights.items() if w and t in self.lists]
        if not own:
            return 0
        own.sort(key=lambda x: -x[0])
        rest = np.r_[np.cumsum([x[0] for x in own][::-1])[::-1], 0].tolist()
        least, at, blocks = best.least, 0, 0
        scores = np.zeros(len(self.ids), np.int64)
        # Essential lists: a document in none of them cannot reach the score asked for.
        while at < len(own) and rest[at] >= least:
            _, weight, postings = own[at]
            docs, counts = postings.read()
            scores[docs] += weight * self.totals.part(counts, self.lengths[docs])
            blocks += len(postings.first)
            at += 1
            if at % LOOK == 0:
                least = max(least, self._kth(scores, best.k))
        found = np.flatnonzero(scores + rest[at] >= max(least, 1))
        found = found[scores[found] > 0]
        for i in range(at, len(own)):
            _, weight, postings = own[i]
            least = max(least, self._kth(scores[found], best.k))
            block = np.searchsorted(postings.first, found, "right") - 1
            most = np.where(block >= 0, weight * postings.bounds[block], 0)
            in_question = scores[found] + most + rest[i + 1] >= least
            found, block = found[in_question], block[in_question]
            needed = np.unique(block[block >= 0])
            if len(needed):
                docs, counts = postings.read(needed)
                place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                hit = docs[place] == found
                scores[found[hit]] += weight * self.totals.part(counts[place[hit]], self.lengths[found[hit]])
                blocks += len(needed)
        found = found[scores[found] >= max(least, 1)]
        best.add(scores[found], self.ids[found], self.nameless[found])
        return blocks

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        """The k-th highest score: parts only add up, so no lower one is among the k best."""
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search_block(index: DataFrame, items: list[tuple[int | None, Counter]], totals: Totals, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best documents for the items."""
    spark = index.sparkSession
    wanted = sorted({t for _, terms in items for t in terms} | {b""})
    lists = index.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term binary")), "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: totals.weight(n) for t, n in df.items() if t}
    queries = [{t: c * weight[t] for t, c in terms.items() if t in weight} for _, terms in items]
    item_ids = [item_id for item_id, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Best(k) for _ in queries]
        number, shard = None, None
        for batch in batches:
            for own, term, n, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "df", "postings"))):
                if own != number:
                    if shard:
                        for query, best in zip(queries, heaps):
                            shard.search(query, best)
                    # The empty term comes first in its shard.
                    number, shard = own, Shard(n, raw, totals)
                else:
                    shard.lists[term] = Postings(raw, totals)
        for query, best in zip(queries, heaps) if shard else ():
            shard.search(query, best)
        for i, best in enumerate(heaps):
            ids = pa.array(best.ids, pa.int64(), mask=best.nameless)
            size = len(best.ids)
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([i] * size, pa.int32()), pa.array([item_ids[i]] * size, pa.int64()), ids, pa.array(best.scores)], ["item", "item_id", "doc_id", "score"])

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = lists.select("shard", "term", "df", "postings").repartition(parts, "shard").sortWithinPartitions("shard", "term")
    return ordered.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of each item's k best documents.

    A document scores the sum over the item's terms, repeats included, of the term's
    weight times the document's part for it, in 64-bit integers; documents of score 0 are
    not listed. Equal scores are ordered by doc_id, null ids last. An item without
    terms, or with none that occurs, has no rows; equal item rows are one item, unlike
    rows of one id are ranked each for itself. Items are searched for in blocks of about
    ``item_bytes`` of text, one after the other.
    """
    spark = index.sparkSession
    sums = index.filter(F.col("term") == F.lit(b"")).agg(F.sum("df").alias("n"), F.sum("words").alias("words")).first()
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not sums["n"]:
        return result
    totals = Totals(sums["n"], sums["words"])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // item_bytes))
    for number in range(count):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        own = [(r["item_id"], Counter(terms_of(bytes(r["text"])))) for r in block.toLocalIterator()]
        own = [x for x in own if x[1]]
        if own:
            found = _search_block(index, own, totals, k)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            # Written before the next block's items are fetched.
            ranked = ranked.select("item_id", "rank", "doc_id", "score")
            result = result.unionByName(stored(ranked, "ranked")) if count > 1 else ranked
    return result


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, shard_words: int = SHARD_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``search`` over an index of all ``docs`` (doc_id, text).

    Null, empty and termless texts are in no total and never found; a very long text is
    indexed whole; repeated rows are documents each; other columns are not read; without
    documents or items there are no rows.
    """
    return search(build_index(docs, shard_words), items, k, item_bytes)
