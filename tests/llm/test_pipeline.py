"""The pipeline, stage by stage, against plain Python on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

import brute
import __spark_entry__ as entry_points
from marketmood.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        text = " ".join(word() for _ in range(90))
        if i % 4 == 3:
            text = " ".join(w.upper() + "###" for w in text.split())
        if i % 10 == 1:
            text += " " + items[i % 5][1]
        if i % 10 == 2:
            text = text[:100] + " " + passage + " " + text[100:]
        if i % 10 == 5:
            text = rows[-1][1] + (" extra" if i % 20 == 5 else "")
        rows.append((i, text, "en", "src%d" % (i % 3), len(text)))
        labels.append((i, int(i % 4 != 3 and text == text.lower()), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, "too short", "en", "src1", 9)]
    path = str(tmp_path_factory.mktemp("corpus"))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_take_effect_and_keep_the_rest(spark, corpus):
    path, items = corpus
    docs = queries.table(spark, path, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], path).cache())
    columns = docs.columns
    assert all(frame.columns == columns for frame in seen[:-1])
    before, judged, linked, cut, clean, encoded = ({r["doc_id"]: r for r in f.collect()} for f in seen)

    assert set(judged) == {d for d, r in before.items() if r["text"] and len(r["text"].split()) > 19 and "#" not in r["text"]}
    groups = brute.components([(d, r["text"]) for d, r in judged.items()])
    assert set(linked) == {component for _, _, component in groups} and len(linked) < len(judged)
    removed = {d: (n, gone) for d, n, gone, _ in brute.without_repeats([(d, r["text"]) for d, r in linked.items()])}
    assert set(cut) == set(linked)
    assert all(len(brute.words(cut[d]["text"])) == n - gone for d, (n, gone) in removed.items())
    assert all(cut[d]["text"] == linked[d]["text"] for d, (_, gone) in removed.items() if not gone)
    assert any(gone for _, gone in removed.values()) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    held = {d for d, *_ in brute.held_items([(d, r["text"]) for d, r in cut.items()], items)}
    assert held and set(clean) == set(cut) - held
    coder = queries.tokenizer()
    assert set(encoded) == set(clean)
    assert all(coder.decode(r["ids"]).decode() == clean[d]["text"] for d, r in encoded.items())

    whole = entry_points.queries()["pipeline"](spark, path)
    assert sorted(tuple(map(str, r)) for r in whole.collect()) == sorted(tuple(map(str, r)) for r in encoded.values())


def test_registered_queries():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
