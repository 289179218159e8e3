"""Ranked lexical search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketmood.llm import lexical_search
from marketmood.llm.queries import REGISTRY

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, item_id string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, own in held:
            m = 75 + 25 * sum(own.values()) * n_docs // n_words
            parts = (math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * own[t] // (1000 * own[t] + 12 * m)) for t in terms(text) if own[t])
            scores.append((-sum(parts), doc_id is None, doc_id))
        out += [(item_id, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(x for x in scores if x[0])[:k])]
    return sorted(out, key=str)


def as_rows(found):
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, n):
    """Texts of Zipf words, some of them rare, with copies and a hot one."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.choice((1, 5, 30, 200))))) for i in range(n)]
    rows += [(n + i, "w3 w77 hot Ünïcode") for i in range(60)] + [(3, rows[3][1]), (None, rows[4][1])]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.choice((1, 4, 40))))) for i in range(25)] + [(90, "hot w3, ÜNÏcode")]
    return rows, items


@pytest.mark.parametrize(("shard_words", "k", "item_bytes"), [(1 << 22, 20, 1 << 22), (500, 3, 1 << 22), (3000, 7, 300), (1, 20, 1 << 22)])
def test_search_equals_scores_of_all(spark, monkeypatch, shard_words, k, item_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    rows, items = corpus(k, 150 if shard_words == 1 else 600)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = lexical_search.ranked_documents(docs, asked, k, shard_words, item_bytes)
    assert as_rows(found) == brute(rows, items, k)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " .,-_\n"), (4, "A-b_C a1²"), (None, "b"), (4, "b b"), (5, "long " * 300_000 + "b"), (6, "b")]
    items = [(1, "B c"), (1, "B c"), (1, "other b"), (2, None), (3, ""), (4, "missing"), (None, "a1² A")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(lexical_search.ranked_documents(docs, asked)) == brute(rows, items)
    assert lexical_search.ranked_documents(docs.limit(0), asked).count() == 0
    assert lexical_search.ranked_documents(docs, asked.limit(0)).count() == 0
    assert lexical_search.ranked_documents(docs.filter("doc_id <= 3"), asked).count() == 0


def test_numbers_survive_packing():
    draw = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, *(draw.randrange(2 ** draw.randrange(1, 40)) for _ in range(500))])
    raw, starts = lexical_search.packed(values)
    assert lexical_search.unpacked(raw).tolist() == values.tolist()
    assert lexical_search.unpacked(raw[starts[5] :]).tolist() == values[5:].tolist()


def test_bounds_leave_blocks_unread():
    """Most blocks of common words are never decompressed once rare words set the score."""
    builder = lexical_search.ShardBuilder()
    draw = random.Random(2)
    for i in range(20_000):
        builder.add(i, [b"common", b"usual"] * draw.randrange(1, 4) + [b"x"] * draw.randrange(30) + ([b"rare"] * 5 if i % 700 == 0 else []))
    rows = list(builder.rows(0))
    totals = lexical_search.Totals(20_000, builder.words)
    shard = lexical_search.Shard(rows[0][2], rows[0][4], totals)
    shard.lists = {term: lexical_search.Postings(raw, totals) for _, term, _, _, raw in rows[1:]}
    weights = {term: totals.weight(n) for _, term, n, _, _ in rows[1:] if term != b"x"}
    best = lexical_search.Best(5)
    read = shard.search(weights, best)
    scores = {i: 0 for i in range(20_000)}
    for term, weight in weights.items():
        docs, counts = shard.lists[term].read()
        for d, s in zip(docs.tolist(), (weight * totals.part(counts, shard.lengths[docs])).tolist()):
            scores[d] += s
    want = sorted((-s, d) for d, s in scores.items())[:5]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    assert read < 0.3 * sum(len(p.first) for t, p in shard.lists.items() if t != b"x")


def test_query_equals_scores_of_all(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert as_rows(REGISTRY["op13_ranked_search"](spark, sf_dir)) == brute(docs, items)
