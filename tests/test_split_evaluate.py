from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketmood.functions import labels as L
from marketmood.operators import evaluate, quality, split


def test_hash_split_is_stable_and_near_its_share(spark):
    rows = spark.range(20000)
    first = split.hash_split(rows, ["id"])
    share = first.filter("is_test").count() / 20000
    assert abs(share - 0.2) < 0.02
    again = split.hash_split(rows.repartition(7), ["id"])
    assert first.exceptAll(again).count() == 0
    other = split.hash_split(rows, ["id"], seed=1).filter("is_test")
    assert first.filter("is_test").exceptAll(other).count() > 0


@pytest.mark.parametrize("n", [1, 5, 11, 997])
def test_exact_split_size(spark, n):
    parts = split.exact_split(spark.range(n), ["id"])
    assert parts.count() == n
    assert parts.filter("is_test").count() == math.ceil(0.2 * n)


def test_stratified_split_with_a_hot_label(spark):
    rows = spark.range(5000).withColumn(
        "label", F.when(F.col("id") % 10 < 8, "bullish").when(F.col("id") % 10 == 8, "neutral").otherwise("bearish")
    )
    parts = split.exact_split(rows, ["id"], strata="label")
    got = {r["label"]: (r["n"], r["t"]) for r in parts.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"bullish": (4000, 800), "neutral": (500, 100), "bearish": (500, 100)}


def test_time_split_keeps_dates_together(spark):
    rows = spark.range(100).select(
        "id", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 10).cast("int")).alias("date")
    )
    parts = split.time_split(rows, "date")
    late = {r["date"].day for r in parts.filter("is_test").collect()}
    assert late == {9, 10} and parts.filter("is_test").count() == 20


def predictions(spark):
    said = [("bullish", "bullish")] * 3 + [("bullish", "bearish")] * 2 + [
        ("bearish", "bearish"), ("bearish", "bullish"), ("neutral", "bullish")]
    return spark.createDataFrame(said, "label string, prediction string")


def test_metrics_by_hand(spark):
    m = evaluate.eval_metrics(predictions(spark)).first()
    assert m["n"] == 8 and m["accuracy"] == 0.5
    assert m["precision"] == pytest.approx((5 * 3 / 5 + 2 * 1 / 3 + 0) / 8)
    assert m["recall"] == pytest.approx((5 * 3 / 5 + 2 * 1 / 2 + 0) / 8)
    assert m["f1"] == pytest.approx((5 * (6 / 10) + 2 * (2 / 5)) / 8)


def test_confusion_is_zero_filled(spark):
    rows = [tuple(r) for r in evaluate.confusion_matrix(predictions(spark)).collect()]
    assert rows == [("bullish", 3, 0, 2), ("neutral", 1, 0, 0), ("bearish", 1, 0, 1)]
    assert sum(sum(r[1:]) for r in rows) == predictions(spark).count()
    empty = predictions(spark).limit(0)
    assert evaluate.eval_metrics(empty).first()["accuracy"] == 0.0


@pytest.mark.parametrize("n", [1, 32, 64, 70])
def test_batch_error_equals_plain_loop(spark, n):
    rows = spark.range(n).select(
        "id", F.col("id").cast("double").alias("target"), (F.col("id") * 0.9).alias("prediction")
    )
    errors = [(i - i * 0.9) ** 2 for i in range(n)]
    batches = [errors[i : i + 32] for i in range(0, n, 32)]
    want = sum(sum(b) / len(b) for b in batches) / len(batches)
    got = evaluate.batch_mean_squared_error(rows, ["id"]).first()
    assert got["n"] == n and got["mse"] == pytest.approx(want)
    assert evaluate.mean_squared_error(rows).first()["mse"] == pytest.approx(sum(errors) / n)


def test_label_functions(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.06,), (-0.05,), (-0.2,)], "s double")
    got = [r[0] for r in rows.select(L.polarity_label(F.col("s"))).collect()]
    assert got == ["neutral", "neutral", "bullish", "neutral", "bearish"]
    shares = L.polarity_shares(F.col("s"))
    for row in rows.select("s", *[c.alias(l) for l, c in shares.items()]).collect():
        assert row["bullish"] + row["neutral"] + row["bearish"] == pytest.approx(1.0)
        if row["s"] > 0:
            assert row["bullish"] == pytest.approx((row["s"] + 0.05) / 1.1)
    tie = rows.limit(1).select(L.best_label({l: F.lit(0.5) for l in L.LABELS})).first()[0]
    assert tie == "bullish"
    soft = rows.limit(1).select(*L.softmax([F.lit(1000.0), F.lit(1000.0), F.lit(None).cast("double")])).first()
    assert list(soft) == [0.5, 0.5, 0.0]
    codes = spark.createDataFrame([(0,), (1,), (2,), (7,)], "c int")
    assert [r[0] for r in codes.select(L.recode(F.col("c"), L.PHRASE_CODES)).collect()] == [
        "bearish", "bullish", "neutral", None]


def test_guards(spark):
    with pytest.raises(ValueError):
        quality.require_rows(spark.range(9), 10)
    assert quality.require_rows(spark.range(10), 10).count() == 10
    with pytest.raises(KeyError):
        quality.require_columns(spark.range(1), ["id", "date"])
