"""Byte-level BPE by a two-tier lookup: a minimal perfect hash, then a heap over linked bytes.

The vocabulary is read from a rank file, never trained. Tier 1 looks a whole
pre-token up in a minimal perfect hash of the vocabulary; tier 2 merges the bytes of
what is not in it. Texts are encoded and decoded where they lie, nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest as digest

from marketmood.llm.common import added_schema, sliced, texts_of

# Pre-tokens remembered within a task; short ones only, so memory is bounded.
REMEMBERED = 400_000
REMEMBERED_BYTES = 48
_GROUP = 2


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, a seed per small group.

    Keys fall into groups by their hash. Large groups first, each takes the first
    displacement that sends all its keys to free slots. ``find`` compares the stored
    key, so strings outside the set are told apart.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.groups = n, max(1, -(-n // _GROUP))
        self.seeds = np.zeros(self.groups, np.uint32)
        self.slots = np.full(n, -1, np.int64)
        members: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = digest(key)
            members.setdefault(h % self.groups, []).append((h, i))
        free = 0
        for group, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                while self.slots[free] >= 0:
                    free += 1
                # A single key takes the next free slot; the top bit marks such a seed.
                self.seeds[group], self.slots[free] = 0x80000000 | free, own[0][1]
                continue
            seed = 0
            while True:
                places = [self._place(h, seed) for h, _ in own]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                seed += 1
            self.seeds[group] = seed
            for place, (_, i) in zip(places, own):
                self.slots[place] = i
        self.keys = [keys[i] for i in self.slots]
        self.values = self.slots.tolist()
        self.seed_list = self.seeds.tolist()

    def _place(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """The index of ``key`` in the list the hash was built from, or -1."""
        if not self.n:
            return -1
        h = digest(key)
        seed = self.seed_list[h % self.groups]
        place = seed & 0x7FFFFFFF if seed & 0x80000000 else self._place(h, seed)
        return self.values[place] if self.keys[place] == key else -1


class Tokenizer:
    """Encoder and decoder for a rank file (token in base64, rank) and a split pattern."""

    def __init__(self, rank_lines: bytes, pattern: str):
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, rank_lines.splitlines()) if token)
        self.ids = [rank for rank, _ in pairs]
        self.tokens = [token for _, token in pairs]
        self.splitter = regex.compile(pattern)
        self.table = PerfectHash(self.tokens)
        self.by_id = dict(pairs)
        self.ranks = {token: rank for rank, token in pairs}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece outside the vocabulary: always the lowest rank first, then the leftmost.

        Parts are linked by their starts; a heap holds the pairs that can be merged.
        An entry whose parts have changed meanwhile is stale and skipped.
        """
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 2))
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = end[start]
            if middle >= stop or middle > n or end[middle] != stop:
                continue
            end[start], end[middle] = stop, n + 1
            before[stop] = start
            if stop < n and (r := rank(piece[start : end[stop]])) is not None:
                heapq.heappush(heap, (r, start, end[stop]))
            left = before[start]
            if left >= 0 and (r := rank(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        at = self.table.find(raw)
        found = (self.ids[at],) if at >= 0 else tuple(self.merge(raw))
        if len(raw) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for match in self.splitter.findall(text):
            out += known.get(match) or self.piece(match)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


def read_tokenizer(path: str, pattern: str) -> Tokenizer:
    """A tokenizer from a vocabulary file, read by the driver; its size is the vocabulary's."""
    with open(path, "rb") as file:
        return Tokenizer(file.read(), pattern)


def encode_texts(
    docs: DataFrame,
    tokenizer: Tokenizer,
    carry: list[str] | None = None,
    with_ids: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return both.

    The columns of ``docs`` (or those in ``carry``) with n_tokens long, ids_sha256 string
    (ids as little-endian unsigned 32-bit integers), decoded_sha256 string and, by
    default, ids array<int> and decoded string added; columns of these names are
    replaced. A null text is encoded like an empty one: no tokens. Bytes of a text that
    are not UTF-8 are encoded as U+FFFD. Repeated rows and null ids are kept as they are.
    """
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    added |= {"ids": "array<int>"} if with_ids else {}
    added |= {"decoded": "string"} if with_text else {}
    carried = [c for c in carry or docs.columns if c not in added]
    source = docs.select(*dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, back, ids_out, decoded = [], [], [], [], []
            for text in texts_of(batch.column("text")):
                ids = tokenizer.encode(text or "")
                raw = tokenizer.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    ids_out.append(ids)
                if with_text:
                    decoded.append(raw.decode())
            columns = [*(batch.column(c) for c in carried), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*carried, *added])

    return source.mapInArrow(sliced(run), added_schema(docs, carried, added))
