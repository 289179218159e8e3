from __future__ import annotations

import random

import numpy as np
import pytest

import brute
from marketmood.llm import common, jaccard_join
from marketmood.llm.jaccard_join import bitmap, keep_one, least_difference, link_documents, prefix_length


def texts(seed=5):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randrange(4000)
    passage = [word() for _ in range(30)]
    rows = []
    for group in range(12):
        size = draw.choice([3, 5, 6, 7, 9, 12, 20, 40, 90])
        base = [word() for _ in range(size)]
        if group % 3 == 0:
            base = base[: size // 2] + passage + base[size // 2 :]
        for _ in range(draw.choice([1, 2, 6])):
            own = list(base)
            for _ in range(draw.randrange(3)):
                at = draw.randrange(len(own) + 1)
                own[at:at] = [word()] if draw.random() < 0.7 else []
                if draw.random() < 0.4 and len(own) > 1:
                    own.pop(draw.randrange(len(own)))
            rows.append(" ".join(own))
    rows += [rows[0]] * 3 + ["", None, "  \n", "One two", "one TWO", "a b c d e", "a b c d e f g", "ÉA b", "éa b"]
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"short_list": 2}, {"short_list": 2, "rounds": 1}])
def test_components_equal_those_of_all_pairs(make_docs, options):
    rows = texts()
    found = link_documents(make_docs(rows), **options).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute.components(rows)


def test_sizes_at_the_limit_link(make_docs):
    """3 of 4 shingles shared links (75 of 100), 2 of 3 does not."""
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g h"), (7, "k l m n o p"), (9, "k l m n o p q")]
    found = {r["doc_id"]: r["component_id"] for r in link_documents(make_docs(rows)).collect()}
    assert found == {4: 2, 2: 2, 7: 7, 9: 9}


def test_null_ids_repeated_rows_and_empty_tables(make_docs):
    text = " ".join(map(str, range(30)))
    rows = [(5, text), (5, text), (None, text), (3, text + " x"), (None, "other words"), (8, None)]
    found = sorted((tuple(r) for r in link_documents(make_docs(rows)).collect()), key=str)
    assert found == sorted([(5, 26, 3), (5, 26, 3), (None, 26, 3), (3, 27, 3), (None, 1, None), (8, 0, 8)], key=str)
    assert link_documents(make_docs([])).count() == 0
    kept = keep_one(make_docs([*rows, (3, text + " x")]))
    # The copy without an id goes, the other text without an id stays.
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(3, text + " x"), (8, None), (None, "other words")], key=str)


def test_keep_one_judges_rows_not_ids(spark):
    """Repeated and null ids with other texts, and columns that clash with names used inside."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 7), (1, b, 7), (2, b, 7), (3, a + " z", 8), (None, c, 1), (None, c, 1), (None, c + " z", 2), (None, "", 3), (None, None, 3), (4, a, 9), (5, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node long")
    kept = sorted((tuple(r) for r in keep_one(docs).collect()), key=str)
    assert [r for r in kept if r[1] in (a, b, a + " z")] == [(1, a, 7), (1, b, 7)][: len([r for r in kept if r[0] == 1])]
    assert {r[1] for r in kept if r[0] == 1} == {a, b} and not [r for r in kept if r[0] in (2, 3, 4)]
    assert len([r for r in kept if r[1] and r[1].startswith("c0")]) == 1
    assert len([r for r in kept if not r[1]]) == 3 and keep_one(docs).columns == docs.columns


def test_pairs_of_a_group_of_near_copies_grow_with_its_size(make_docs, monkeypatch):
    """One-word variants of one text: most pairs of them are no links, one component in the end."""
    seen = []
    close = jaccard_join._close_enough

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return close(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_close_enough", counted)
    made = []
    for size in (400, 800):
        draw = random.Random(size)
        rows = []
        for i in range(size):
            words = ["v%d" % k for k in range(60)]
            words[draw.randrange(60)] = "new%d" % i
            rows.append((i, " ".join(words)))
        seen.clear()
        found = link_documents(make_docs(rows))
        assert {r["component_id"] for r in found.collect()} == {0}
        made.append(sum(seen))
    assert made[0] < 60 * 400 and made[1] < 60 * 800, made


@pytest.mark.parametrize("leaders", [2, 8])
def test_waves_lose_no_link(make_docs, monkeypatch, leaders):
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    rows = texts(9)
    found = link_documents(make_docs(rows), short_list=1, rounds=1).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute.components(rows)


def test_sets_in_too_few_open_lists_are_not_joined_again(make_docs, monkeypatch):
    """Unlike texts with one passage, each met by a task of its own; long near copies are joined again."""
    seen = []
    list_rows = jaccard_join._list_rows

    def counted(docs, wanted, *rest):
        if wanted is not None:
            seen.extend(wanted.collect())
        return list_rows(docs, wanted, *rest)

    monkeypatch.setattr(jaccard_join, "_list_rows", counted)
    passage = " ".join("p%d" % i for i in range(14))
    rows = [(i, " ".join("t%d-%d" % (i, k) for k in range(200)) + " " + passage) for i in range(12)]
    assert sorted(tuple(r) for r in link_documents(make_docs(rows).repartition(12), short_list=4).collect()) == [(i, 210, i) for i in range(12)]
    assert not seen
    copies = []
    for i in range(12):
        words = ["c%d" % k for k in range(200)]
        for at in range(3 + i, 200, 25):
            words[at] = "new%d-%d" % (i, at)
        copies.append((100 + i, " ".join(words)))
    found = link_documents(make_docs(rows + copies).repartition(24), short_list=4).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute.components(rows + copies)
    assert seen and {r["doc_id"] for r in seen} <= {d for d, _ in copies}


@pytest.mark.parametrize("options", [{"short_list": 1, "rounds": 1}, {"short_list": 2}])
def test_tables_too_large_to_broadcast_lose_no_link(make_docs, monkeypatch, options):
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    rows = texts(9)
    assert sorted((tuple(r) for r in link_documents(make_docs(rows), **options).collect()), key=str) == brute.components(rows)


@pytest.mark.parametrize("options", [{}, {"short_list": 2}])
def test_null_ids_link_as_near_copies_and_as_bridges(make_docs, options):
    words = ["n%d" % i for i in range(60)]
    chain = [" ".join(words[i : i + 40]) for i in (0, 4, 8)]
    other = " ".join("m%d" % i for i in range(30))
    rows = [(None if i % 3 else i, t) for i, t in texts()]
    rows += [(903, other), (None, other + " x"), (None, other + " y"), (911, chain[0]), (None, chain[1]), (912, chain[2])]
    found = sorted((tuple(r) for r in link_documents(make_docs(rows), **options).collect()), key=str)
    assert found == brute.components(rows)
    assert (912, 36, 911) in found and found.count((None, 27, 903)) == 2


def test_bitmaps_bound_the_symmetric_difference():
    draw = np.random.default_rng(1)
    for n, m in ((10, 12), (300, 500), (3000, 3100)):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], draw.integers(0, 2**63, m).astype(np.uint64)]))
        assert least_difference(bitmap(a), bitmap(b)) <= len(np.setxor1d(a, b))
        assert least_difference(bitmap(a), bitmap(a)) == 0
    assert prefix_length(4) == 2 and prefix_length(400, 2) == 102
