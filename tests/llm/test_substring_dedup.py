from __future__ import annotations

import random

import pytest

import brute
from marketmood.llm.substring_dedup import SuffixAutomaton, find_spans, remove_repeats


def rows(seed=3):
    draw = random.Random(seed)
    word = lambda: "v%d" % draw.randrange(50_000)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 120)]
    out = []
    for doc in range(40):
        own = [word() for _ in range(draw.choice([0, 5, 60]))]
        for _ in range(draw.randrange(3)):
            own += draw.choice(passages) + [word() for _ in range(draw.choice([0, 1, 30]))]
        out.append((draw.randrange(1000) * 40 + doc, " ".join(own)))
    out += [(50_001, out[3][1]), (50_002, "x " * 120), (50_003, "y x " + "x " * 130), (50_004, None), (50_005, " \n")]
    out.append((50_006, "  ".join(passages[3]) + "\n\tend"))
    return out


@pytest.mark.parametrize("held", [200, 2])
def test_words_removed_equal_those_found_window_by_window(make_docs, monkeypatch, held):
    monkeypatch.setattr(find_spans, "__defaults__", (50, 16, held))
    found = remove_repeats(make_docs(rows()), carry=["doc_id"], with_text=False)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute.without_repeats(rows())


def repeated_inside(seed=8):
    """Documents P X P of which smaller ones hold parts of P, some in two rows of one id."""
    draw = random.Random(seed)
    fresh = lambda n: ["u%d" % draw.randrange(10**9) for _ in range(n)]
    out = []
    for group in range(12):
        passage, low, size = fresh(160), draw.randrange(40), draw.randrange(55, 110)
        part = fresh(20) + passage[low : low + size] + fresh(20)
        texts = [part, passage + fresh(7 * group) + passage, fresh(30) + passage + fresh(9) + passage + passage + fresh(5)]
        ids = [group * 10, group * 10 + 3, group * 10 + draw.choice([3, 6])]
        out += list(zip(ids, map(" ".join, texts)))
    return out


@pytest.mark.parametrize("held", [200, 1])
def test_every_repeat_inside_the_smallest_document_is_cut(make_docs, monkeypatch, held):
    monkeypatch.setattr(find_spans, "__defaults__", (50, 16, held))
    found = remove_repeats(make_docs(repeated_inside()), carry=["doc_id"], with_text=False)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute.without_repeats(repeated_inside())


def test_text_that_is_left_keeps_its_spacing(make_docs):
    passage = " ".join("p%d" % i for i in range(60))
    docs = make_docs([(1, "one  " + passage), (2, "\tsome\n\n" + passage + "\n last  word "), (3, None)])
    found = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert found[1]["text"] == "one  " + passage and found[3]["text"] is None
    assert found[2]["text"] == "\tsome\n\nlast  word " and found[2]["n_removed"] == 60
    assert docs.columns == list(found[2].asDict())[:3]


def test_null_ids_repeated_ids_and_clashing_columns(make_docs, spark):
    text = " ".join("q%d" % i for i in range(55))
    docs = make_docs([(None, text), (7, text), (7, text + " more"), (9, text + " tail")])
    found = remove_repeats(docs, carry=["doc_id"], with_text=False).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in found), key=str) == sorted([(None, 0), (7, 0), (7, 0), (9, 55)], key=str)
    clash = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, n_words long, spans long")
    assert [tuple(r)[:4] for r in remove_repeats(clash).select("doc_id", "text", "spans", "n_words").collect()] == [(1, "a", 6, 1)]
    assert remove_repeats(make_docs([])).count() == 0


def test_automaton_spans_are_the_maximal_ones():
    draw = random.Random(2)
    for _ in range(200):
        texts = [[bytes([draw.choice(b"abc")]) for _ in range(draw.randrange(1, 15))] for _ in range(3)]
        own = [bytes([draw.choice(b"abc")]) for _ in range(draw.randrange(0, 15))]
        machine = SuffixAutomaton()
        for t in texts:
            machine.add(t)
        covered = set()
        for low, high in machine.spans(own, 3):
            covered.update(range(low, high))
        inside = {tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)}
        want = {j for i in range(len(own) - 2) if tuple(own[i : i + 3]) in inside for j in range(i, i + 3)}
        assert covered >= want
        # Every reported position lies in a window of width 3 that a text contains.
        assert covered == want
