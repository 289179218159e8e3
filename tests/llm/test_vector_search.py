"""Exact top-k search against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from marketmood.llm import vector_search
from marketmood.llm.queries import REGISTRY

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=10, every=100):
    """Rows per query by comparing it with everything, in plain integers."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query_id, query in {(i, tuple(v)) for i, v in good if i is not None and i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i is None, i) for i, v in good if i != query_id)
        out += [(query_id, n + 1, i, -s) for n, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def as_rows(found):
    assert [n for n, _ in found.dtypes] == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def cloud(seed, n, dim, scale=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [scale * (c + draw.gauss(0, 0.3)) for c in draw.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("dim", "visits", "visitors"), [(8, 3, 2048), (3, 1, 2), (16, 4, 1)])
def test_search_equals_all_products(spark, monkeypatch, dim, visits, visitors):
    monkeypatch.setattr(vector_search, "BLOCK_VALUES", 16 * dim)
    rows = cloud(dim, 900, dim)
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(7)
    found = vector_search.top_k(frame, every=20, visits=visits, visitors=visitors, first_visit=40, growth=3, annuli=4)
    assert as_rows(found) == brute(rows, every=20)


def test_common_vectors_ties_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_VALUES", 64)
    rows = cloud(1, 100, 4) + [(1000 + i, [1.0, 1.0, 0.0, 0.5]) for i in range(300)] + [(2000 + i, [50.0, -3.0, 0.001, 0.0]) for i in range(3)]
    rows += [(1000, [1.0, 1.0, 0.0, 0.5]), (200, [0.1]), (200, []), (7, [0.5, 0.5]), (None, [60.0, 0.0, 0.0, 0.0]), (None, None)]
    rows += [(300, None), (400, [1.0, None]), (500, [math.nan, 1.0]), (600, [1.0, math.inf]), (-100, [-0.00001, 1.0, 0.0, 0.0])]
    found = vector_search.top_k(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5), first_visit=20, growth=2)
    assert as_rows(found) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert as_rows(vector_search.top_k(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == brute(rows) == [(0, 1, 1, 11 * 1024 * 1024)]
    for none in ([], [(100, None, "x")]):
        assert vector_search.top_k(spark.createDataFrame(none, SCHEMA)).count() == 0


def test_large_values_are_exact():
    one, two = np.array([[2.0**31 + 1, 3.0]]), np.array([[2.0**31 - 1, 5.0], [1.0, 1.0]])
    assert vector_search.inner_products(one, two).tolist() == [[2**62 - 1 + 15, 2**31 + 4]]
    with pytest.raises(OverflowError):
        vector_search.inner_products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_most_of_the_index_is_not_visited(spark):
    """On clustered vectors the bounds rule out most annuli."""
    rows = vector_search.usable(spark.createDataFrame([(*r, "x") for r in cloud(5, 2000, 16)], SCHEMA))
    space = vector_search.fit_space(rows)
    blocks = vector_search._blocks(vector_search._keyed(rows, space), space, 4, 2)
    rings = vector_search.Annuli(blocks.collect(), space)
    vectors = np.floor(1024 * np.array([v for _, v in cloud(5, 2000, 16)]))
    queries = vectors[::50]
    scores = np.sort(queries @ vectors.T, axis=1)[:, -11]
    open_rings = rings.least_distances(queries) <= space.radius(queries, scores)[:, None]
    assert (open_rings * rings.n).sum() < 0.6 * len(queries) * len(vectors)


def test_a_query_visits_a_cell_once(spark, monkeypatch):
    """Vectors without clusters, of which no annulus can be ruled out: rows that move grow with cells, not with annuli."""
    monkeypatch.setattr(vector_search, "CELL_VALUES", 16 * 200, raising=False)
    monkeypatch.setattr(vector_search, "BOUNDS", 300, raising=False)
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(1000, 16))
    rows = vector_search.usable(spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors.tolist())], SCHEMA))
    space = vector_search.fit_space(rows)
    keyed = vector_search._keyed(rows, space)
    rings = vector_search.Annuli(vector_search._blocks(keyed, space, 8, 2).orderBy("pivot", "annulus").collect(), space)
    asked = keyed.filter("vec_id % 20 = 0").selectExpr("cast(cast(vec_id as string) as binary) query", "vec_id query_id", "code", "cast(null as long) worst")
    visits = vector_search._visits(asked, rings, 0, True, 1, 1).collect()
    assert len(visits) <= 50 * 10
    cells = rings.cell[-1] + 1
    assert 5 <= cells <= 10 and len(rings.n) > 100
    assert len(visits) == 50 * cells == len({(r["query_id"], r["cell"]) for r in visits})
    assert sum(int.from_bytes(r["places"], "big").bit_count() for r in visits) == 50 * len(rings.n)
    # The annuli of a turn are told from those of the turn before by their order, so it may not depend on the batch.
    queries = np.floor(1024 * vectors[::20])
    alone = np.concatenate([rings.least_distances(queries[i : i + 1]) for i in range(50)])
    assert (rings.least_distances(queries) == alone).all()


def test_a_large_annulus_is_dealt_in_pieces(spark, monkeypatch):
    for name, value in (("BLOCK_VALUES", 40), ("CELL_VALUES", 120), ("BOUNDS", 64), ("PRODUCTS", 90)):
        monkeypatch.setattr(vector_search, name, value)
    rows = cloud(2, 120, 4) + [(1000 + i, [1.0, 1.0, 0.0, 0.5]) for i in range(250)] + [(None, [1.0, 1.0, 0.0, 0.5])] * 2
    found = vector_search.top_k(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5), every=50, visitors=3, first_visit=20, growth=2)
    assert as_rows(found) == brute(rows, every=50)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query_equals_all_products(spark, sf_dir, kind):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    found = REGISTRY["op12_vector_topk"](spark, sf_dir) if kind == "float" else vector_search.top_k(frame.selectExpr("vec_id", "cast(embedding as array<double>) embedding"))
    assert as_rows(found) == brute(rows)
