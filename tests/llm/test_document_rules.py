"""Quality rules, compression classifier, language identification and licence scans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from marketmood.llm import language, licenses, quality_classifier, quality_rules, trees

EDGES = ["", None, " \n\t", "one", "é#ü $x\n\nsame line\nsame line\n \nsame line ", "a b c d e f g h " * 6, "x\x0by\x0cz\u00a0w\u2003v"]


def labelled(spark, n=200):
    """Good documents of words, bad ones of symbols; ids 0 to n."""
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w.upper() + "### |" for w in words]), ["en", "fr"][i % 2]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_counts_of_the_quality_rules(make_docs):
    texts = [*EDGES, "lorem ipsum dolor " * 20, "\n".join("line %d" % (i % 4) for i in range(30))]
    docs = make_docs(list(enumerate(texts)) + [(None, "x"), (3, "one")])
    forest = trees.fit(np.empty((0, len(quality_rules.FEATURES))), np.empty(0), {})
    found = quality_rules.score_quality(docs, forest, carry=["doc_id"]).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        text = "x" if row["doc_id"] is None else texts[row["doc_id"]]
        counts = brute.quality_counts(text)
        assert tuple(row[c] for c in quality_rules.COUNTS) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_quality_rules_learn_and_keep_their_direction(spark):
    docs, labels = labelled(spark)
    forest = quality_rules.fit_rules(docs, labels)
    judged = quality_rules.score_quality(docs.withColumn("kept", F.lit("own")), forest).join(labels, "doc_id").collect()
    assert all(r["kept"] == bool(r[-1]) for r in judged)
    x = np.random.default_rng(0).uniform(0, 5, (300, len(quality_rules.FEATURES)))
    for feature in quality_rules.MONOTONE:
        more = x.copy()
        more[:, feature] += 1
        assert (forest.score(more) <= forest.score(x) + 1e-12).all()
    empty = quality_rules.fit_rules(docs.limit(0), labels)
    assert empty.score(x).min() > 0.9


def test_trees_follow_a_monotone_constraint_against_the_data():
    draw = np.random.default_rng(3)
    x = draw.uniform(0, 1, (2000, 2))
    y = ((x[:, 0] > 0.3) & (x[:, 0] < 0.6) | (x[:, 1] > 0.8)).astype(float)
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], 1)
    free, bound = trees.fit(x, y, {}), trees.fit(x, y, {0: 1})
    assert ((free.score(x) > 0.5) == y).mean() > 0.97
    assert (np.diff(bound.score(grid)) >= -1e-12).all()


def test_classifier_tells_held_out_texts_apart(spark):
    docs, labels = labelled(spark, 400)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality_classifier.fit(docs, labels, ~held_out)
    found = quality_classifier.classify(docs.filter(held_out), model, carry=["doc_id"]).join(labels, "doc_id").collect()
    assert len(found) > 50 and np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95
    edges = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)] + [(None, "x" * 100_000)], "doc_id long, text string")
    scores = quality_classifier.classify(edges, model).collect()
    assert len(scores) == len(EDGES) + 1 and all(0 <= r["score"] <= 1 for r in scores)
    nothing = quality_classifier.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_classifier.classify(edges, nothing).collect()} == {0.5}
    assert quality_classifier.classify(edges.limit(0), model).count() == 0


def test_language_filters(spark, make_docs):
    draw = random.Random(4)
    alphabets = {"aa": "abcdeé", "bb": "abcdeñ", "cc": "stuvwü"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(draw.choice(alphabets[lang]) for _ in range(5)) for _ in range(20)), lang))
    docs = make_docs(rows)
    model = language.fit(docs, F.col("doc_id") % 4 != 1)
    found = language.identify(docs.filter("doc_id % 4 = 1"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    edges = make_docs([(1, None), (2, ""), (3, "123 !? 4"), (None, "ЖЖЖ"), (5, "stuvwü" * 9000)])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(edges, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] == "cc" and got[None] in alphabets
    none = language.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(docs.limit(2), none).collect()} == {"und"}


def test_every_language_is_learned(make_docs):
    count, rows = 270, []
    for i in range(3 * count):
        letters = [chr(0x4E00 + 6 * (i % count) + j) for j in range(6)]
        rows.append((i, " ".join("".join(letters[(j + k) % 6] for k in range(4)) for j in range(6)), "l%03d" % (i % count)))
    docs = make_docs(rows)
    model = language.fit(docs, F.col("doc_id") < 2 * count)
    found = language.identify(docs.filter(F.col("doc_id") >= 2 * count), model).collect()
    assert len(found) == count and all(r["lang_pred"] == r["lang"] for r in found)


def test_language_filters_hold_what_was_added_and_few_others():
    model = language.Filters(["a", "b"], np.array([0.5, 0.5]), np.zeros((1 << 12, 1), np.uint64), language.letter_table())
    grams = np.random.default_rng(2).integers(0, 2**62, 600).astype(np.uint64)
    model.add(0, grams[:400])
    model.add(1, grams[300:])
    first, *rest = model.places(grams)
    masks = model.table[first]
    for place in rest:
        masks = masks & model.table[place]
    assert model.bits(masks, 0)[:400].all() and model.bits(masks, 1)[300:].all()
    others = np.random.default_rng(3).integers(0, 2**62, 4000).astype(np.uint64)
    hits = model.table[model.places(others)[0]]
    for place in model.places(others)[1:]:
        hits = hits & model.table[place]
    assert abs(model.bits(hits, 0).mean() - model.rates()[0]) < 0.02


LICENSED = [
    "Released under the MIT License.",
    "x Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0. CC BY-NC BY NC",
    "cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "permission is hereby granted free of charge to deal in the software without restriction",
    "under the mit",
    "license under the mit license" + " word" * 3000,
    "UNDER É the mit license",
    None,
    "",
]


def test_licence_places_and_labels(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(LICENSED)] + [(None, LICENSED[0], "y", 8)], "doc_id long, text string, words string, labels long")
    found = licenses.scan(docs).collect()
    assert len(found) == len(LICENSED) + 1
    for row in found:
        text = LICENSED[0] if row["doc_id"] is None else LICENSED[row["doc_id"]]
        got = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert got == brute.license_base(text, licenses.BASE)
        assert row["text"] == text and 0 <= row["score"] <= 1
        assert set(row["base_labels"].split(",")) <= set(row["labels"].split(",")) | {""}
    labels = {r["doc_id"]: r["labels"] for r in found}
    assert labels[3] == "all-rights-reserved,gpl-3" and labels[4] == "mit" and labels[5] == "" and labels[None] == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("carry", [["doc_id"], None])
def test_licence_scan_runs_no_python(spark, make_docs, carry):
    plan = licenses.scan(make_docs([(1, "x")]), carry=carry)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
