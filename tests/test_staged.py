"""Regression in stages, and Naive Bayes that is continued."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS
from marketmood.operators import bayes, staged
from marketmood.plans.models import BayesModel, StagedModel

GENERAL = [("great profit growth", "bullish"), ("weak loss fraud", "bearish"), ("the board met", "neutral")] * 20
# The specific corpus uses "loss" and a word of its own differently.
SPECIFIC = [("loss leader campaign", "bullish"), ("profit warning issued", "bearish"), ("the campaign met", "neutral"), (None, "neutral"), ("x", "unknown")] * 6
SCHEMA = "text string, label string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "news_id long, cleaned_text string, sentiment string")


def test_gradient_is_that_of_the_loss(spark):
    rows = spark.createDataFrame(SPECIFIC, SCHEMA)
    label = F.when(F.col("label") == "bullish", 0).when(F.col("label") == "neutral", 1).when(F.col("label") == "bearish", 2)
    ready = rows.select(label.alias("label"), staged._features(F.col("text"), 32).alias("words")).filter("label is not null").coalesce(3)
    weights = np.random.default_rng(1).normal(size=(33, 3))
    n, loss, gradient = staged._objective(ready, weights)
    assert n == 24
    for place in ((32, 1), *np.argwhere(np.abs(gradient) > 1e-6)[:2].tolist()):
        ahead = weights.copy()
        ahead[tuple(place)] += 1e-6
        assert (staged._objective(ready, ahead)[1] - loss) / 1e-6 == pytest.approx(gradient[tuple(place)], abs=1e-3)


def test_a_worker_takes_its_batch_in_blocks(spark, monkeypatch):
    """Whole rows, all of them, never more features at once than the bound but for one long text."""
    monkeypatch.setattr(staged, "BLOCK", 10)
    sizes = np.array([0, 4, 6, 1, 25, 0, 0, 10, 3])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)))], ["row"])
    blocks = [b.column("row").to_pylist() for b in staged._blocks(batch, sizes)]
    assert sum(blocks, []) == list(range(len(sizes))) and len(blocks) == 5
    assert all(sizes[b].sum() <= 10 or sizes[b].max() == sizes[b].sum() for b in blocks)
    rows = spark.createDataFrame([(0, "b a b"), (1, None), (2, "aa bb aa cc")], "label int, text string").coalesce(1)
    ready = rows.select("label", staged._features(F.col("text"), 32).alias("words"))
    packed = {r["label"]: r for r in staged._packed(ready).collect()}
    for row in ready.collect():
        assert np.frombuffer(bytes(packed[row["label"]]["at"]), "<i4").tolist() == [w["at"] for w in row["words"]]
        assert np.frombuffer(bytes(packed[row["label"]]["x"]), "<f8").tolist() == [w["x"] for w in row["words"]]


def test_specific_stage_is_pulled_towards_the_general_one(spark):
    general = staged.fit(spark.createDataFrame(GENERAL, SCHEMA).coalesce(2), features=1 << 10, max_iter=6)
    specific = spark.createDataFrame(SPECIFIC, SCHEMA).coalesce(2)
    fits = [staged.fit(specific, general, 1 << 10, max_iter=6, pull=p) for p in (1e-3, 1e3)]
    far = [np.abs(m.weights[:-1] - general.weights[:-1]).sum() for m in fits]
    assert far[0] > 20 * far[1]
    docs = rows_of(spark, [r for r in SPECIFIC if r[1] != "unknown"])
    likelihood = [
        staged.log_likelihood(staged.predict(docs, m, ["news_id", "sentiment"], "cleaned_text"), "sentiment").first()["log_likelihood"]
        for m in (general, fits[0])
    ]
    assert likelihood[1] > likelihood[0]
    # What the specific corpus never mentions is still known from the general one.
    asked = spark.createDataFrame([(1, "growth"), (2, ""), (3, None)], "news_id long, cleaned_text string")
    said = sorted(staged.predict(asked, fits[0], ["news_id"], "cleaned_text").collect())
    assert len(said) == 3 and said[0]["bullish"] > 1.5 * said[1]["bullish"] and said[1][1:] == said[2][1:]
    assert all(abs(sum(r[l] for l in LABELS) - 1) < 1e-9 for r in said)


def test_no_rows_leave_the_stage_before(spark):
    general = staged.fit(spark.createDataFrame(GENERAL, SCHEMA), features=64, max_iter=3)
    again = staged.fit(spark.createDataFrame([], SCHEMA), general, 64)
    assert np.array_equal(general.weights, again.weights)
    with pytest.raises(ValueError):
        staged.fit(spark.createDataFrame([], SCHEMA), general, 128)


def test_staged_model_in_the_interface(spark, tmp_path):
    model = StagedModel(256, 4).train(rows_of(spark, SPECIFIC[:3]), spark.createDataFrame(GENERAL, SCHEMA))
    model.save(str(tmp_path / "m"))
    again = StagedModel(256, 4).load(spark, str(tmp_path / "m"))
    assert np.array_equal(model.model.weights, again.model.weights)


def test_continued_bayes_equals_one_fit(spark, tmp_path):
    general = spark.createDataFrame(GENERAL, SCHEMA)
    parts = [SPECIFIC[:2], SPECIFIC[2:9], SPECIFIC[9:]]
    model = BayesModel().start(general)
    for i, part in enumerate(parts):
        model.save(str(tmp_path / str(i)))
        model = BayesModel().load(spark, str(tmp_path / str(i))).train_more(rows_of(spark, part))
    whole = {r["token"]: r for r in bayes.fit(spark.createDataFrame(SPECIFIC, SCHEMA), general).collect()}
    found = {r["token"]: r for r in model.weights.collect()}
    assert set(found) == set(whole) and "campaign" not in found
    for token, row in whole.items():
        assert [found[token][f"w_{l}"] for l in LABELS] == pytest.approx([row[f"w_{l}"] for l in LABELS])
    assert model.predict(rows_of(spark, SPECIFIC)).count() == len(SPECIFIC)
