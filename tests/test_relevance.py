"""BM25 ranking of articles through impact blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from marketmood.operators import relevance

WORD = re.compile(r"\w{2,}")


def brute(articles, phrases, k):
    counted = [(t, i, Counter(WORD.findall((x or "").lower()))) for t, i, x in articles]
    n, total = len(counted), sum(sum(c.values()) for _, _, c in counted)
    df = Counter(w for _, _, c in counted for w in c)
    mean = total / n or 1.0
    out = []
    for ticker in {t for t, _ in phrases}:
        words = {w for t, w in phrases if t == ticker}
        scores = []
        for own, i, c in counted:
            if own != ticker:
                continue
            score = 0
            for w in words:
                if c[w]:
                    part = math.floor(1_000_000 * 2.2 * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))
                    score += math.floor(1_000_000 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) * part
            if score:
                scores.append((-score, i))
        out += [(ticker, r + 1, i, round(-s / 1e12, 6)) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(draw.choice("AAAB") + "x", i, " ".join(draw.choices(words, weights, k=draw.choice((1, 8, 60))))) for i in range(n)]
    return rows + [("Ax", n + i, "w3 w3 acme") for i in range(40)] + [("Ax", 9001, None), ("Bx", 9002, ""), (None, 9003, "w3 acme")]


@pytest.mark.parametrize(("k", "block"), [(5, 128), (100, 4), (10_000, 16)])
def test_ranking_equals_scores_of_all(spark, monkeypatch, k, block):
    monkeypatch.setattr(relevance, "BLOCK", block)
    rows = corpus(500, k)
    articles = spark.createDataFrame(rows, "ticker string, news_id long, body string")
    names = spark.createDataFrame([("Ax", "w3 Acme w40"), ("Bx", "w1"), ("Cx", "none")], "ticker string, company string")
    found = relevance.most_relevant(articles, names, "body", k)
    phrases = [("Ax", w) for w in ("ax", "w3", "acme", "w40")] + [("Bx", "bx"), ("Bx", "w1"), ("Cx", "cx"), ("Cx", "none")]
    assert sorted((r["ticker"], r["rank"], r["news_id"], round(r["score"], 6)) for r in found.collect()) == brute(rows, phrases, k)


def test_most_blocks_are_not_read(spark):
    rows = corpus(4000)
    articles = spark.createDataFrame(rows, "ticker string, news_id long, body string")
    blocks, frequencies = relevance.index_articles(articles, "body")
    phrases = spark.createDataFrame([("Ax", "w2"), ("Bx", "w1"), ("Bx", "missing")], "ticker string, token string")
    levels = relevance.needed_levels(blocks, relevance._weights(frequencies), phrases, 10)
    read = blocks.join(levels, ["ticker", "token", "level"]).agg({"n": "sum"}).first()[0]
    held = blocks.join(phrases, ["ticker", "token"]).agg({"n": "sum"}).first()[0]
    assert read < 0.5 * held
    assert blocks.filter("size(postings) <> n or low > high").count() == 0


def test_no_articles(spark):
    articles = spark.createDataFrame([], "ticker string, news_id long, body string")
    names = spark.createDataFrame([("Ax", "x1")], "ticker string, company string")
    assert relevance.most_relevant(articles, names, "body").count() == 0
