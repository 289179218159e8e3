"""Properties of the physical plans and results on skewed keys."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from marketmood.checks.queries import REGISTRY
from marketmood.functions.labels import LABELS
from marketmood.operators import align, backtest, bayes, daily, prices
from marketmood import storage
from marketmood.storage import written

PLANNED = (
    "stock_returns", "sentiment_labels", "normalized_prices", "clean_news", "training_frame",
    "join_date_only", "split_exact", "nb_predict", "tfidf_nb", "lexicon_polarity",
    "aggregate_daily", "sequence_windows", "holding_value", "chart_markers",
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_pair_joins_and_no_python_rows(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name](spark, sf_dir))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan


def test_returns_read_their_input_once(spark, sf_dir):
    plan = plan_of(REGISTRY["stock_returns"](spark, sf_dir))
    assert plan.count("FileScan") == 1 and plan.count("Window [") == 1


def test_no_text_crosses_the_vector_join(spark, sf_dir):
    for name in ("daily_mean_embedding", "aggregate_daily"):
        plan = plan_of(REGISTRY[name](spark, sf_dir))
        shuffled = [l for l in plan.splitlines() if "Exchange hashpartitioning(news_id" in l or "BroadcastExchange" in l]
        assert shuffled
        joins = [l for l in plan.splitlines() if "Join" in l and "news_id" in l]
        assert joins
    narrow = daily.embed_or_zero(
        spark.createDataFrame([(1, "a")], "news_id long, cleaned_text string"),
        spark.createDataFrame([(1, [1.0])], "news_id long, embedding array<float>"), 1,
    )
    assert "cleaned_text" not in narrow.columns and narrow.first()["text_length"] == 1


def test_scan_reads_needed_columns_only(spark, sf_dir):
    plan = plan_of(REGISTRY["news_top_per_ticker"](spark, sf_dir))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("text" not in r for r in read)


def test_scoring_moves_texts_not_words(spark):
    """The exchange of a scoring plan sits above a partial sum per text."""
    docs = written(
        spark.range(10).select(F.col("id").alias("news_id"), F.lit("profit loss").alias("text")), "docs"
    )
    train = spark.createDataFrame([("profit", "bullish"), ("loss", "bearish")], "text string, label string")
    plan = plan_of(bayes.joint_scores(docs, bayes.fit(train), ["news_id"], "text"))
    above = plan.split("Exchange hashpartitioning(news_id")[0]
    below = plan.split("Exchange hashpartitioning(news_id")[1]
    assert "explode" not in above and "partial_sum" in below and "BroadcastHashJoin" in below


def test_large_word_tables_are_broadcast_in_pieces(spark, monkeypatch):
    """At any limit words meet the model by broadcast, and only sums per text move."""
    docs = written(
        spark.range(40).select(
            F.col("id").alias("news_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * k) % 50) for k in range(9)]).alias("text")
        ),
        "docs",
    )
    train = docs.select("text", F.when(F.col("news_id") % 2 == 0, "bullish").otherwise("bearish").alias("label"))
    weights = bayes.fit(train)
    whole = sorted(bayes.joint_scores(docs, weights, ["news_id"], "text").collect())
    idf = written(bayes.inverse_document_frequency(docs, "text"), "idf")
    scaled = sorted(bayes.tfidf(docs, idf, ["news_id"], "text").collect())
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1024)
    pieces = bayes.joint_scores(docs, weights, ["news_id"], "text")
    plan = plan_of(pieces)
    assert plan.count("BroadcastHashJoin") > 3 and "SortMergeJoin" not in plan
    assert "hashpartitioning(token" not in plan
    for a, b in zip(sorted(pieces.collect()), whole, strict=True):
        assert a["news_id"] == b["news_id"]
        assert [a[l] for l in LABELS if b[l] is not None] == pytest.approx([b[l] for l in LABELS if b[l] is not None])
    again = sorted(bayes.tfidf(docs, idf, ["news_id"], "text").collect())
    assert [tuple(r)[:2] for r in again] == [tuple(r)[:2] for r in scaled]
    assert [r["tfidf"] for r in again] == pytest.approx([r["tfidf"] for r in scaled])


def test_texts_are_read_a_fixed_number_of_times_however_large_the_model(spark, monkeypatch):
    """A model of many times the broadcast limit adds no pass over the texts."""
    docs = written(
        spark.range(40).select(
            F.col("id").alias("news_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * k) % 50) for k in range(9)]).alias("text")
        ),
        "docs",
    )
    weights = bayes.fit(docs.select("text", F.when(F.col("news_id") % 2 == 0, "bullish").otherwise("bearish").alias("label")))
    whole = sorted(bayes.joint_scores(docs, weights, ["news_id"], "text").collect())
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 150)
    assert storage.table_bytes(weights) > 20 * storage.BROADCAST_BYTES
    parts = bayes.joint_scores(docs, weights, ["news_id"], "text")
    assert plan_of(parts).count("explode(") <= 3
    for a, b in zip(sorted(parts.collect()), whole, strict=True):
        assert a["news_id"] == b["news_id"] and a["bullish"] == pytest.approx(b["bullish"]) and a["bearish"] == pytest.approx(b["bearish"])


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("limit", [10_000, 400, 30])
def test_word_joins_in_parts_are_plain_joins(spark, how, limit):
    """Keys repeat and are null on both sides; the rows asked for are those of one join."""
    words = written(spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("w0"), (F.col("id") * F.col("id")) % 37)).alias("token")), "words")
    table = written(spark.range(60).select(F.when(F.col("id") % 9 != 0, F.concat(F.lit("w0"), F.col("id") % 29)).alias("token"), F.col("id").alias("x")), "table")
    expected = sorted(words.join(table, "token", how).collect(), key=str)
    for often in (None, F.col("x"), F.when(F.col("x") > 30, 1.0)):
        found = storage.in_pieces(words, table, "token", how, often, limit)
        assert expected and sorted(found.collect(), key=str) == expected


def test_hot_ticker_day_gives_whole_results(spark):
    """A third of all news on one ticker and day."""
    start, n = dt.date(2024, 1, 1), 30000
    hot = F.col("id") % 3 == 0
    news = spark.range(n).select(
        F.col("id").alias("news_id"),
        F.when(hot, F.lit(start)).otherwise(F.date_add(F.lit(start), (F.col("id") % 20).cast("int"))).alias("date"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 40)).alias("ticker"),
        F.concat(F.lit("word"), F.col("id") % 5).alias("cleaned_text"),
    )
    tickers = ["HOT"] + [f"T{k}" for k in range(40)]
    bars = spark.createDataFrame(
        [(t, start + dt.timedelta(days=i), 10.0 + (i * (k + 1)) % 5) for k, t in enumerate(tickers) for i in range(20)],
        "ticker string, date date, close double",
    )
    index = bars.filter("ticker = 'HOT'").select("date", F.lit(5.0).alias("close"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = align.training_frame(news, prices.sentiment_labels(bars, index), bars)
        assert rows.count() == n
        assert rows.filter("ticker = 'HOT'").count() == n // 3
        once = align.build_features(
            align.align_news_labels(news, prices.sentiment_labels(bars, index)), bars
        ).select(*rows.columns)
        assert rows.exceptAll(once).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    said = news.withColumn("prediction", F.when(F.col("news_id") == 0, "bearish").otherwise("bullish"))
    signals = backtest.first_signal_per_day(said)
    assert signals.filter("ticker = 'HOT'").first()["signal"] == "bearish"
    vectors = said.select(
        "news_id", "date", "ticker", F.length("cleaned_text").alias("text_length"), F.col("prediction").alias("sentiment"),
        F.array(F.col("news_id").cast("double"), F.lit(1.0)).alias("embedding"),
    )
    day = daily.aggregate_daily(vectors).filter("ticker = 'HOT'").first()
    assert day["embedding"][0] == pytest.approx(sum(range(0, n, 3)) / (n / 3))
    assert day["sentiment"] == "bullish" and day["n_articles"] == n // 3
