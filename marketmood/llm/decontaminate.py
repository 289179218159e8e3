"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly.

An item is found in a document that holds at least ``PERCENT`` of the item's distinct
5-word shingles, wherever they stand. Items are short and documents may be long, so
the similarity of the two sets says little; the item's side alone is sketched. Its
sketch is its bottom-k MinHash, with k as many shingles as could be missing plus one:
every document that holds enough of the item holds one of them. Items are partitioned
by size; a document probes only partitions whose items it is large enough to hold.

Sketches are rows. One scan of the documents keeps those with a window in a bit table of
all sketches, whose size is bounded; their hits meet the sketches in a join, and the
pairs that come of it are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.llm.common import SHINGLE_WORDS, if_small, mix, sliced, stored, window_hashes
from marketmood.llm.wordscan import WordScanner

PERCENT = 75
# The bit table has 32 bits per sketched shingle within these powers of two; a fuller one
# lets more documents through to the join.
LEAST_BITS, MOST_BITS = 12, 27
# Tasks that unite the other tasks' bits.
FAN = 4
_SALT = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _keys(hashes: np.ndarray, width: int, part: int) -> np.ndarray:
    """Window hashes as keys of one partition: items of one shingle width and size class."""
    return mix(hashes ^ np.uint64((width * 64 + part) * _SALT % (1 << 64)))


def _sketches(rows: DataFrame, percent: int) -> DataFrame:
    """(item, width, part, need, key): a row per sketched shingle of each item with a word."""
    names = ["item", "width", "part", "need", "key"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                width = min(SHINGLE_WORDS, len(words))
                n = len(shingles(words, width))
                need, part = -(-percent * n // 100), n.bit_length()
                hashes = np.unique(window_hashes(scanner.scan(text.lower())[0], width))
                own = _keys(hashes[: n - need + 1], width, part).view(np.int64)
                out += [(item, width, part, need, key) for key in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(sliced(run), "item binary, width int, part int, need long, key long")


def _bit_table(sketches: DataFrame, bits: int) -> np.ndarray:
    """A bit per key modulo 2 ** bits, packed; united by tasks, not by the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[batch.column("key").to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], ["bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for raw in batch.column("bits").to_pylist():
                table |= np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    parts = sketches.select("key").mapInArrow(own, "bits binary").repartition(FAN).mapInArrow(united, "bits binary")
    for row in parts.toLocalIterator():
        table |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def _candidates(source: DataFrame, table: np.ndarray, bits: int, parts: list[tuple[int, int, int]]) -> DataFrame:
    """The (tag, text) rows with a sketched shingle in all likelihood, with the keys that say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = scanner.scan((text or b"").lower())[0]
                windows: dict[int, np.ndarray] = {}
                found = []
                for width, part, least in parts:
                    if width not in windows:
                        windows[width] = window_hashes(words, width)
                    if len(windows[width]) < least:
                        continue
                    keys = _keys(windows[width], width, part)
                    place = keys & np.uint64((1 << bits) - 1)
                    found.append(keys[(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)])
                own = np.unique(np.concatenate(found)) if found else ()
                if len(own):
                    at.append(i)
                    hits.append(own.view(np.int64))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.list_(pa.int64()))], [*kept.schema.names, "keys"])

    schema = T.StructType([*source.schema.fields, *T.StructType.fromDDL("keys array<long>").fields])
    return source.mapInArrow(sliced(run), schema)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(tag, item_id, n_item_shingles, n_shared) of the (tag, text, items) rows' items that the text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            at, found = [], []
            for i, (text, items) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist())):
                lower = text.lower()
                words, hashes = lower.split(), scanner.scan(lower)[0]
                windows: dict[int, np.ndarray] = {}
                for item in items:
                    own = words_of(item["text"])
                    width = min(SHINGLE_WORDS, len(own))
                    if width not in windows:
                        windows[width] = window_hashes(hashes, width)
                    wanted = shingles(own, width)
                    places = np.flatnonzero(np.isin(windows[width], window_hashes(scanner.scan(item["text"].lower())[0], width)))
                    shared = {tuple(words[p : p + width]) for p in places.tolist()} & wanted
                    if 100 * len(shared) >= percent * len(wanted):
                        at.append(i)
                        found.append((item["item_id"], len(wanted), len(shared)))
            columns = [batch.column("tag").take(pa.array(at, pa.int64())), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["tag", "item_id", "n_item_shingles", "n_shared"])

    schema = T.StructType([pairs.schema["tag"], *T.StructType.fromDDL("item_id long, n_item_shingles long, n_shared long").fields])
    return pairs.select("tag", "text", "items").mapInArrow(sliced(run), schema)


def _held(source: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(tag, item_id, n_item_shingles, n_shared): the items each (tag, text) row contains."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    name = F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.col("text")))
    rows = stored(rows.select(F.unhex(name).alias("item"), "item_id", "text"), "items")
    sketches = stored(_sketches(rows, percent), "sketches")
    # At most a row per shingle width and power of two.
    sizes = sketches.groupBy("width", "part").agg(F.min("need").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("width", "part").collect()
    parts = [(r["width"], r["part"], r["least"]) for r in sizes]
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * sum(r["n"] for r in sizes)).bit_length()))
    found = stored(_candidates(source, _bit_table(sketches, bits), bits, parts).withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = found.select("row", F.explode("keys").alias("key")).join(if_small(sketches.select("key", "item")), "key")
    pairs = hits.select("row", "item").distinct().join(if_small(rows), "item")
    listed = stored(pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "pairs")
    return _verified(found.select("row", "tag", "text").join(if_small(listed), "row"), percent)


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every (document, item) where the document contains the item.

    Returns doc_id, item_id, n_item_shingles, n_shared (long) and containment (double):
    one row per document row and item row found. Words are lower-cased (A-Z). An item
    of fewer than five words is one shingle, its whole sequence; an empty or null item
    is in no document, an empty or null document holds none. Repeated document rows are
    reported each; equal item rows once. Other columns of either table are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("tag"), F.col("text").cast("binary").alias("text"))
    found = _held(source, items, percent)
    return found.select(F.col("tag").alias("doc_id"), "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item.

    Rows are told apart by a digest of their text, which alone decides.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    source = docs.select(digest.alias("tag"), F.col("text").cast("binary").alias("text"))
    found = if_small(stored(_held(source, items, percent).select(F.col("tag").alias("_digest")).distinct(), "held"))
    return docs.join(found, F.unhex(F.md5(docs["text"].cast("binary"))) == found["_digest"], "left_anti")
