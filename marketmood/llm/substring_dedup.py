"""Substring deduplication with suffix automata over sharded reference passages.

A window of ``width`` words is removed from a document if a document with a smaller id
also contains it. The reference for a document thus is all smaller documents; it is cut
into shards so that an automaton only meets text that can match it:

* every window belongs to the cell of its anchor, the smallest hash of the word runs
  inside it. Equal windows have equal anchors, wherever they stand. Cells follow each
  other, about one to twenty words;
* equal cells are grouped by a hash of their content: all but those of the smallest id
  are removed as a whole, so copies of any number meet in a sum, not in a task;
* where an anchor has several contents, its passages are one reference shard: each
  content's first passage is streamed through the suffix automaton of the passages with
  smaller ids, whose matching statistics tell the maximal spans of ``width`` words or
  more, and then joins the automaton. The spans hold for all cells of that content in
  the first passage's document. Shards of more passages than HELD would be an
  unbounded group; their windows are matched by hash in a pre-aggregated sum instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from marketmood.llm.common import added_schema, if_small, sliced, stored, window_hashes
from marketmood.llm.wordscan import WordScanner

WIDTH = 50
# Words in the runs whose smallest hash is a window's anchor.
RUN = 16
# Passages of one anchor that meet in an automaton, at most; bounds its memory to about
# 200 MB where all passages differ.
HELD = 3000


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        """Extend by one sequence; substrings never reach over two sequences."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, known, word)
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = state
                at = link[at]
            if at >= 0:
                target = nexts[at][word]
                link[state] = target if length[target] == length[at] + 1 else self._split(at, target, word)
            last = state

    def _split(self, at: int, target: int, word: bytes) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def spans(self, words: list[bytes], width: int) -> list[tuple[int, int]]:
        """Maximal runs of words covered by matches of at least ``width`` words."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        found: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            if matched >= width:
                start = i + 1 - matched
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
        return found


def _row_key(text: bytes) -> int:
    """Tells rows of one id but different texts apart."""
    return xxh32_intdigest(text) - (1 << 31)


def _cells(docs: DataFrame, width: int, run: int) -> DataFrame:
    """(anchor, content, doc_id, row, start, count): the windows of each cell of each text."""
    schema = "anchor long, content long, doc_id long, row int, start int, count int"
    names = ["anchor", "content", "doc_id", "row", "start", "count"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = scanner.scan(text)[0]
                n = len(words) - width + 1
                if n <= 0:
                    continue
                runs = window_hashes(words, run)
                at = np.arange(n) + sliding_window_view(runs, width - run + 1).argmin(axis=1)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                counts = np.diff(np.r_[starts, n])
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(words * scanner.powers[: len(words)], out=sums[1:])
                    content = (sums[starts + counts + width - 1] - sums[starts]) * scanner.inverses[starts]
                    content = content * np.uint64(31) + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                # The anchor's place in the cell is part of the content: it fixes which windows these are.
                content ^= window_hashes((at[starts] - starts).astype(np.uint64) + np.uint64(1), 1)
                values = (runs[at[starts]].view(np.int64), content.view(np.int64), np.full(len(starts), doc_id, np.int64))
                values += (np.full(len(starts), _row_key(text), np.int32), starts.astype(np.int32), counts.astype(np.int32))
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [np.int64] * 3 + [np.int32] * 3
            columns = [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    rows = docs.filter("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sliced(cut), schema)


def _passages(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(anchor, content, doc_id, row, start, large, text): the words of each wanted cell's windows."""
    names = ["anchor", "content", "doc_id", "row", "start", "large", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, cells in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cells"))):
                words, key = None, _row_key(text)
                for cell in cells:
                    if cell["row"] == key:
                        words = words if words is not None else text.split()
                        own = words[cell["start"] : cell["start"] + cell["count"] + width - 1]
                        rows.append((cell["anchor"], cell["content"], doc_id, key, cell["start"], cell["large"], b" ".join(own)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    # A document's cells are as many as its length allows.
    per_doc = stored(
        wanted.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "count", "anchor", "content", "large")).alias("cells")),
        "wanted",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    return texts.join(if_small(per_doc), "doc_id").select("doc_id", "text", "cells").mapInArrow(sliced(cut), "anchor long, content long, doc_id long, row int, start int, large boolean, text binary").distinct()


def _matched(passages: DataFrame, width: int) -> DataFrame:
    """Spans of words that a smaller document of the shard contains, with their cell: (anchor,
    content, doc_id, row, start, low, high)."""
    names = ["anchor", "content", "doc_id", "row", "start", "low", "high"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton, waiting, last_doc = None, SuffixAutomaton(), [], None
        for batch in batches:
            rows = []
            for own, content, doc_id, row, start, text in zip(*(batch.column(c).to_pylist() for c in (*names[:5], "text"))):
                if own != anchor:
                    anchor, automaton, waiting = own, SuffixAutomaton(), []
                elif doc_id != last_doc:
                    for words in waiting:
                        automaton.add(words)
                    waiting = []
                last_doc = doc_id
                words = text.split()
                rows += [(own, content, doc_id, row, start, start + low, start + high) for low, high in automaton.spans(words, width)]
                waiting.append(words)
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    parts = max(2, int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = passages.filter("not large").repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "row", "start")
    return ordered.mapInArrow(sliced(match), "anchor long, content long, doc_id long, row int, start int, low int, high int")


def _counted(passages: DataFrame, width: int) -> DataFrame:
    """The same spans for shards too large for one automaton, by the smallest id per window."""
    names = ["window", "low", "anchor", "content", "doc_id", "row", "start"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            rows: list[list] = [[], []]
            at: list[np.ndarray] = []
            for i, (start, text) in enumerate(zip(batch.column("start").to_pylist(), batch.column("text").to_pylist())):
                windows = window_hashes(scanner.scan(text)[0], width)
                n = len(windows)
                rows[0].append(windows.view(np.int64))
                rows[1].append(np.arange(start, start + n, dtype=np.int32))
                at.append(np.full(n, i, np.int64))
            own = batch.select(names[2:]).take(pa.array(np.concatenate(at) if at else np.empty(0, np.int64)))
            columns = [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(rows, (np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *own.columns], names)

    windows = passages.filter("large").mapInArrow(sliced(explode), "window long, low int, anchor long, content long, doc_id long, row int, start int")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("window", "first")
    return windows.join(first, "window").filter("first < doc_id").select("anchor", "content", "doc_id", "row", "start", "low", (F.col("low") + width).alias("high"))


def find_spans(docs: DataFrame, width: int = WIDTH, run: int = RUN, held: int = HELD) -> DataFrame:
    """(doc_id, spans) with spans array<struct<row, low, high>> of words to remove, disjoint and sorted."""
    cells = stored(_cells(docs, width, min(run, width)), "cells")
    contents = stored(
        cells.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "row", "start", "count")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("cells")),
        "contents",
    )
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("passages"), F.min("first.doc_id").alias("low"), F.max("last").alias("high"))
    several = several.filter("passages > 1 and low < high").select("anchor", (F.col("passages") > held).alias("large"))
    # One cell of each open content is matched; a content is named where it has other cells.
    named = F.when(F.col("cells") > 1, F.col("content")).alias("content")
    wanted = contents.join(several, "anchor").select("anchor", named, "large", "first.doc_id", "first.row", "first.start", "first.count")
    passages = stored(_passages(docs, wanted, width), "passages")
    matched = stored(_matched(passages, width).unionByName(_counted(passages, width)), "matched")
    # The smallest document may have the content in several places: all of them have these spans.
    places = cells.select("anchor", "content", "doc_id", F.col("row").alias("to_row"), F.col("start").alias("to_start"))
    carried = places.join(if_small(matched.filter("content is not null")), ["anchor", "content", "doc_id"]).filter("to_row <> row or to_start <> start")
    shift = F.col("to_start") - F.col("start")
    carried = carried.select("doc_id", F.col("to_row").alias("row"), (F.col("low") + shift).alias("low"), (F.col("high") + shift).alias("high"))
    found = matched.select("doc_id", "row", "low", "high").unionByName(carried)

    shared = contents.filter("first.doc_id < last").select("anchor", "content", F.col("first.doc_id").alias("first"))
    copies = cells.join(shared, ["anchor", "content"]).filter("first < doc_id")
    whole = copies.select("doc_id", "row", F.col("start").alias("low"), (F.col("start") + F.col("count") + width - 1).alias("high"))
    # A document's spans are as many as its length allows.
    listed = whole.unionByName(found).groupBy("doc_id").agg(F.collect_list(F.struct("row", "low", "high")).alias("spans"))
    kinds = pa.list_(pa.struct([("row", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [merged_spans(spans) for spans in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(merged, kinds)], ["doc_id", "spans"])

    return listed.mapInArrow(sliced(merge), "doc_id long, spans array<struct<row: int, low: int, high: int>>")


def merged_spans(spans: list[dict]) -> list[dict]:
    """Overlapping and touching spans of a row joined."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["row"], s["low"])):
        if out and out[-1]["row"] == span["row"] and span["low"] <= out[-1]["high"]:
            out[-1]["high"] = max(out[-1]["high"], span["high"])
        else:
            out.append(dict(span))
    return out


def removed_words(n: int, spans: list[dict] | None, row: int) -> np.ndarray:
    """A flag per word of a text."""
    step = np.zeros(n + 1, np.int64)
    for span in spans or ():
        if span["row"] == row:
            step[span["low"]] += 1
            step[min(span["high"], n)] -= 1
    return step[:-1].cumsum() > 0


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with repeated passages removed.

    Added: n_words, n_removed (long) and kept_sha256 (string; kept words joined by one
    space). With ``with_text`` the column text, if carried, holds what is left: the text
    unchanged where nothing is removed, else without the bytes from each removed run's
    first word to the next kept word. A null text has no words and stays null. Rows with
    a null id lose nothing and count for nothing. Rows that repeat an id are one
    document: they never shorten each other. Texts below ``width`` words stay whole.
    Columns of ``docs`` with an added name are replaced.
    """
    added = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    carried = [c for c in carry or docs.columns if c not in added]
    spans = stored(find_spans(docs, width), "spans")
    columns = list(dict.fromkeys([*carried, "text"]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*columns).alias("own"))
    joined = own.join(if_small(spans), "doc_id", "left").select("own", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            fields = dict(zip(columns, batch.column("own").flatten()))
            for text, spans in zip(fields["text"].cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                words = (text or b"").split()
                gone = removed_words(len(words), spans, _row_key(text)) if spans and text else np.zeros(len(words), bool)
                n = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if n else words
                counts.append(len(words))
                removed.append(n)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if n and with_text:
                    starts = scanner.scan(text)[1]
                    keep = np.repeat(~gone, np.diff(np.r_[starts, len(text)]))
                    left = np.frombuffer(text, np.uint8)[starts[0] :][keep].tobytes()
                    text = text[: starts[0]] + left if kept else b""
                texts.append(text)
            own = []
            for name in carried:
                column = fields[name]
                # An unsafe cast leaves bytes that are not UTF-8 as they are.
                own.append(pa.array(texts, pa.binary()).cast(column.type, safe=False) if name == "text" and with_text else column)
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], [*carried, *added])

    return joined.mapInArrow(sliced(cut), added_schema(docs, carried, added))
