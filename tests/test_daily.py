from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS
from marketmood.operators import daily, forecast, evaluate, learned, sequences, split

D = dt.date(2024, 1, 1)
ARTICLE = "news_id long, date date, ticker string, cleaned_text string, sentiment string, embedding array<float>"


def articles(spark):
    return spark.createDataFrame(
        [
            (5000, D, "A", "late", "bearish", [1.0, 2.0]),
            (2, D, "A", "second", "bullish", [3.0, 4.0]),
            (1, D, "A", "first", "neutral", [5.0, 0.0]),
            (9, D, "B", "only", "bullish", [1.0, 1.0]),
            (10, D, "C", "x", "bullish", [0.0, 0.0]),
            (11, D, "C", "y", "bearish", [2.0, 0.0]),
        ],
        ARTICLE,
    )


def test_aggregate_daily(spark):
    rows = articles(spark).withColumn("text_length", F.length("cleaned_text"))
    got = {r["ticker"]: r for r in daily.aggregate_daily(rows).collect()}
    assert list(got["A"]["embedding"]) == pytest.approx([3.0, 2.0])
    assert got["A"]["sentiment"] == "bearish"  # three-way tie, smallest word
    assert got["C"]["sentiment"] == "bearish"
    assert got["B"]["sentiment"] == "bullish"
    assert (got["A"]["n_articles"], got["A"]["text_length"]) == (3, len("first second late"))
    mean = {r["ticker"]: list(r["embedding"]) for r in daily.daily_mean_embedding(rows).collect()}
    assert mean["C"] == [1.0, 0.0]
    mode = {r["ticker"]: r["sentiment"] for r in daily.daily_modal_sentiment(rows).collect()}
    assert mode == {"A": "bearish", "B": "bullish", "C": "bearish"}


def test_modal_sentiment_of_foreign_and_missing_labels(spark):
    rows = spark.createDataFrame(
        [(D, "A", "positive"), (D, "A", "bullish"), (D, "A", "negative"), (D, "B", None)],
        "date date, ticker string, sentiment string",
    )
    assert {r["ticker"]: r["sentiment"] for r in daily.daily_modal_sentiment(rows).collect()} == {"A": "bullish", "B": "neutral"}
    with pytest.raises(Exception, match="unknown sentiment: good"):
        daily.daily_modal_sentiment(rows.withColumn("sentiment", F.lit("good"))).collect()


def test_a_day_a_thousand_times_the_others_has_one_row(spark):
    """The grain follows from the key: a hot day has one row, its texts one row each."""
    rows = spark.range(30000).select(
        F.col("id").alias("news_id"),
        F.lit(D).alias("date"),
        F.when(F.col("id") % 30 != 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id"))).alias("ticker"),
        F.concat(F.lit("w"), F.col("id")).alias("cleaned_text"),
        F.lit("bullish").alias("sentiment"),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    days = daily.aggregate_daily(rows.withColumn("text_length", F.length("cleaned_text")))
    assert days.count() == days.select("date", "ticker").distinct().count() == 1001
    hot = days.filter("ticker = 'HOT'").first()
    own = [f"w{i}" for i in range(30000) if i % 30]
    assert (hot["n_articles"], hot["text_length"]) == (29000, len(" ".join(own)))
    texts = daily.daily_text(rows).filter("ticker = 'HOT'").orderBy("news_id").collect()
    assert [r["cleaned_text"] for r in texts] == own
    assert [r["position"] for r in texts] == list(range(len(own)))
    joined = " ".join(own)
    assert all(joined[r["start"] :].startswith(r["cleaned_text"]) for r in texts)
    assert texts[-1]["start"] + len(own[-1]) == len(joined)


def test_partial_days_merge_in_any_grouping(spark):
    rows = spark.range(500).select(
        F.col("id").alias("news_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("date"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise("B").alias("ticker"),
        F.get(F.array(*[F.lit(x) for x in ("bullish", "positive", "negative", None)]), (F.col("id") % 4).cast("int")).alias("sentiment"),
        (F.col("id") % 9).cast("int").alias("text_length"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"),
    )
    whole = {(r["date"], r["ticker"]): r for r in daily.aggregate_daily(rows).collect()}
    a, b, c = (daily.partial_days(rows.filter(F.col("news_id") % 3 == i)) for i in range(3))
    for merged in (daily.merge_days(a, b, c), daily.merge_days(daily.merge_days(c, a), b)):
        found = daily.finish_days(merged).collect()
        assert len(found) == len(whole)
        for r in found:
            want = whole[r["date"], r["ticker"]]
            assert list(r["embedding"]) == pytest.approx(list(want["embedding"]))
            assert [r[x] for x in ("sentiment", "n_articles", "text_length")] == [want[x] for x in ("sentiment", "n_articles", "text_length")]


def test_zero_vector_for_missing_embedding_or_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "news_id long, cleaned_text string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (3, [3.0, 3.0])], "news_id long, embedding array<float>")
    got = {r["news_id"]: list(r["embedding"]) for r in daily.embed_or_zero(docs, vectors, 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_user_model_runs_on_batches(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "news_id long, cleaned_text string")

    def loader():
        def run(texts):
            n = len(texts)
            sizes = np.array([[len(t), 1.0] for t in texts], dtype="float32")
            return {"sentiment": np.array(["positive"] * n), "embedding": sizes}

        return run

    got = {r["news_id"]: (r["sentiment"], list(r["embedding"])) for r in learned.infer(docs, loader, 2).collect()}
    assert got == {1: ("bullish", [3.0, 1.0]), 2: ("neutral", [0.0, 0.0]), 3: ("neutral", [0.0, 0.0])}


def counting_model():
    class CountingModel:
        """Vectors of a token's id; fails on a batch of more places than allowed."""

        labels = ("bullish", "neutral", "bearish")

        def tokens(self, text):
            return [len(w) for w in text.split()]

        def __call__(self, ids, mask):
            assert ids.shape == mask.shape and (ids.size <= 64 or len(ids) == 1) and ids.shape[1] <= 16
            scores = np.stack([(ids == k).sum(axis=1) / mask.sum(axis=1) for k in (1, 2, 3)], axis=1)
            return np.stack([ids, np.ones_like(ids)], axis=2).astype("float32"), scores

    return CountingModel


def test_pooled_inference_of_long_and_short_texts(spark):
    long = " ".join(["aa"] * 15_000 + ["bbb"] * 5_000)
    texts = ["a bb bb", "", None, long, "ccc " * 17, "x"] + [f"{'y ' * (i % 9)}zz zz" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "news_id int, cleaned_text string, sentiment string").coalesce(2)
    found = {r["news_id"]: r for r in learned.infer_pooled(docs, counting_model(), 2, chunk_tokens=16, batch_tokens=64).collect()}
    assert set(found) == set(range(len(texts)))
    for i, text in enumerate(texts):
        sizes = [len(w) for w in (text or "").split()]
        want = [sum(sizes) / len(sizes), 1.0] if sizes else [0.0, 0.0]
        assert list(found[i]["embedding"]) == pytest.approx(want, rel=1e-6)
        counts = [sizes.count(k) for k in (1, 2, 3)]
        assert found[i]["sentiment"] == (LABELS[counts.index(max(counts))] if sizes else "neutral")
    # Batches hold chunks of like length and few places.
    sizes = [1, 16, 16, 3, 2, 16, 15, 1, 4]
    batches = list(learned._buckets(sizes, 32))
    assert sorted(i for b in batches for i in b) == list(range(len(sizes)))
    assert all(len(b) * max(sizes[i] for i in b) <= 32 for b in batches)


def feature_rows(spark, sizes, step=3):
    rows = [
        (t, D + dt.timedelta(days=i * step), [float(i), 0.5], float(100 + i))
        for t, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "ticker string, date date, features array<double>, close double")


@pytest.mark.parametrize("block", [4, 16, 256])
def test_windows_are_whole_across_blocks_and_years(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "_BLOCK", block)
    sizes = {"A": 300, "B": 10, "C": 11}
    got = sequences.sequence_windows(feature_rows(spark, sizes), 10).collect()
    assert len(got) == sum(max(0, n - 10) for n in sizes.values())
    for row in got:
        i = (row["start_date"] - D).days // 3
        assert [x[0] for x in row["seq"]] == [float(k) for k in range(i, i + 10)]
        assert row["target"] == 100.0 + i + 10


def test_null_target_is_kept(spark):
    rows = feature_rows(spark, {"A": 12}).withColumn(
        "close", F.when(F.col("close") != 111, F.col("close"))
    )
    got = sorted(sequences.sequence_windows(rows, 10).collect(), key=lambda r: r["start_date"])
    assert [r["target"] for r in got] == [110.0, None]


def test_feature_rows_join_bars(spark):
    days = spark.createDataFrame([(D, "A", [1.0]), (D, "B", [2.0])], "date date, ticker string, embedding array<double>")
    bars = spark.createDataFrame(
        [(D, "A", 1.0, 2.0, 3.0, 4.0, 7)],
        "date date, ticker string, open double, high double, low double, close double, volume long",
    )
    got = sequences.feature_rows(days, bars).collect()
    assert [(r["ticker"], list(r["features"])) for r in got] == [("A", [1.0, 1.0, 2.0, 3.0, 4.0, 7.0])]


def price_rows(spark, n, dim=2, seed=0):
    """Days whose close goes back to 100, with a vector that tells the next close a little."""
    draw = np.random.default_rng(seed)
    rows = []
    for ticker in ("A", "B"):
        close = 100 + 10 * draw.normal(size=n)
        for i in range(n):
            hint = [float(close[min(i + 1, n - 1)] - 100) / 10] + [float(x) for x in draw.normal(size=dim - 1)]
            prices = [float(close[i] + x) for x in (-1, 2, -2)] + [float(close[i]), float(draw.integers(1, 9))]
            rows.append((ticker, D + dt.timedelta(days=i), hint + prices, float(close[i])))
    return spark.createDataFrame(rows, "ticker string, date date, features array<double>, close double")


@pytest.mark.parametrize("block", [16, 256])
def test_members_from_one_pass_equal_a_plain_solve(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "_BLOCK", block)
    monkeypatch.setattr(forecast, "_BLOCK", block)
    rows = price_rows(spark, 90)
    blocks = sequences.sequence_blocks(rows, 3)
    sums = forecast.gram(blocks, 7, 3, 4)
    windows = sequences.windows_of(blocks, 3).collect()
    x, y = np.array([r["seq"] for r in windows]), np.array([r["target"] for r in windows])
    mean, unit = forecast._scale(x)
    z, goal = forecast.described(x, 4), (y - mean) / unit
    assert sums[-1] == len(windows) == 2 * 87
    for strength, weights, intercept, _ in forecast.ridge(sums, z.shape[1], (1e-3, 0.1, 10.0)):
        w = unit**2
        centre = (w[:, None] * z).sum(axis=0) / w.sum()
        apart = z - centre
        spread = (w[:, None] * apart).T @ apart / w.sum()
        middle = (w * goal).sum() / w.sum()
        want = np.linalg.solve(spread + strength * np.diag(np.diag(spread)), (w[:, None] * apart).T @ (goal - middle) / w.sum())
        assert weights == pytest.approx(want, abs=1e-6)
        assert intercept == pytest.approx(middle - centre @ want, abs=1e-6)


def test_forecast_beats_the_last_close_and_splits_by_window(spark):
    blocks = sequences.sequence_blocks(price_rows(spark, 400), 5).persist()
    model = forecast.fit_members(blocks, 7, 5, widths=(4, 8), chosen=lambda *key: ~split.in_test(key))
    assert len({len(m.weights) for m in model.members}) == 2
    said = forecast.predict_mean(blocks, model, lambda *key: split.in_test(key)).persist()
    flags = split.hash_split(sequences.windows_of(blocks, 5).select("ticker", "start_date"), ["ticker", "start_date"]).filter("is_test")
    assert sorted((r[0], r[1]) for r in said.select("ticker", "start_date").collect()) == sorted((r[0], r[1]) for r in flags.collect())
    own = evaluate.mean_squared_error(said).first()["mse"]
    last = evaluate.mean_squared_error(said, prediction="last_close").first()["mse"]
    assert own < 0.5 * last
    assert said.filter("abs(prediction - (member_0 + member_1) / 2) > 1e-9").count() == 0


def test_forecast_without_windows_and_with_gaps(spark):
    rows = price_rows(spark, 30).withColumn("close", F.when(F.col("date") != D + dt.timedelta(days=20), F.col("close")))
    blocks = sequences.sequence_blocks(rows, 5)
    model = forecast.fit_members(blocks, 7, 5, widths=(4,), chosen=lambda ticker, date: F.lit(False))
    said = forecast.predict_mean(blocks, model).collect()
    assert len(said) == 50 and sum(r["target"] is None for r in said) == 2
    assert forecast.gram(blocks, 7, 5, 4)[-1] == 48


def test_member_mean(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 8.0)], "a double, b double, c double")
    assert forecast.mean_prediction(rows, ["a", "b", "c"]).first()["prediction"] == 4.0
