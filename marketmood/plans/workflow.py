"""End-to-end workflows over landed tables.

Each stage that several later ones read is written once; everything in between
is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.operators import (
    align,
    backtest,
    charts,
    daily,
    evaluate,
    forecast,
    learned,
    news_text,
    prices,
    quality,
    sequences,
    split,
)
from marketmood.plans.models import TextModel, get_model
from marketmood.sources import sinks
from marketmood.sources.schemas import NEWS_COLUMNS
from marketmood.storage import written


@dataclass
class Inputs:
    """Landed tables: news with ``news_id``, stock bars, index bars."""

    news: DataFrame
    stock: DataFrame
    index: DataFrame

    def checked(self) -> Inputs:
        quality.require_columns(self.news, ["news_id", *NEWS_COLUMNS], "news")
        for name in ("news", "stock", "index"):
            quality.require_rows(getattr(self, name), 1, name)
        return self


def training_rows(inputs: Inputs, path: str) -> DataFrame:
    """Clean, label, align and add features; stages are kept under ``path``."""
    spark = inputs.news.sparkSession
    processed, labels = f"{path}/processed_news", f"{path}/sentiment_labels"
    sinks.write_by_ticker(news_text.clean_news(inputs.news), processed)
    sinks.write_by_ticker(prices.sentiment_labels(inputs.stock, inputs.index), labels)
    rows = align.training_frame(
        sinks.read_table(spark, processed),
        sinks.read_table(spark, labels),
        inputs.stock,
    )
    return quality.require_rows(
        written(rows, "training-rows"), quality.MIN_ROWS, "training rows"
    )


def classify(
    inputs: Inputs,
    model_type: str,
    path: str,
    general: DataFrame | None = None,
    **options,
) -> tuple[TextModel, DataFrame]:
    """Train on 80 % of the aligned news, evaluate on the rest; (model, metrics)."""
    rows = split.hash_split(training_rows(inputs.checked(), path), ["news_id"])
    model = get_model(model_type, **options).train(rows.filter("NOT is_test"), general)
    model.save(f"{path}/{model_type}/model")
    metrics = model.evaluate(rows.filter("is_test"), f"{path}/{model_type}")
    return model, metrics


def follow_tickers(
    model: TextModel, rows: DataFrame, stock: DataFrame, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Each day's first signal beside the value of holding the ticker; (days, metrics)."""
    said = model.predict(rows, ("news_id", "ticker", "date"))
    value = backtest.holding_value(stock)
    days = value.join(backtest.first_signal_per_day(said), ["ticker", "date"], "left")
    metrics = backtest.backtest_metrics(value)
    if path is not None:
        sinks.write_backtest_metrics(metrics, path)
    return days, metrics


def forecast_close(
    inputs: Inputs,
    make_predict_fn: Callable,
    dim: int,
    length: int = sequences.SEQ_LENGTH,
    by_time: bool = False,
    batch: int = 32,
    previous_close: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Embed, aggregate per day, build sequences, fit, test; (daily rows, mse row).

    ``by_time`` tests on the latest start dates instead of a random fifth, which
    keeps overlapping windows apart. ``previous_close`` adds that column to the daily rows.
    """
    checked = inputs.checked()
    articles = learned.infer(news_text.clean_news(checked.news), make_predict_fn, dim)
    articles = articles.withColumn("text_length", F.length("cleaned_text"))
    days = written(daily.aggregate_daily(articles), "daily")
    bars = checked.stock
    if previous_close:
        days = days.join(prices.previous_close(bars), ["date", "ticker"], "left")
    rows = written(sequences.feature_rows(days, bars), "feature-rows")
    blocks = written(sequences.sequence_blocks(rows, length), "sequence-blocks")
    if by_time:
        starts = sequences.start_dates(blocks, length)
        dates = split.time_split(written(starts, "starts"), "start_date").filter("is_test")
        cut = dates.agg(F.min("start_date")).first()[0]

        def tested(ticker: Column, date: Column) -> Column:
            return date >= F.lit(cut) if cut is not None else F.lit(False)
    else:

        def tested(ticker: Column, date: Column) -> Column:
            return split.in_test([ticker, date], seed=1)

    width = dim + len(sequences.PRICE_COLUMNS)
    model = forecast.fit_members(blocks, width, length, chosen=lambda *key: ~tested(*key))
    said = written(forecast.predict_mean(blocks, model, tested), "forecasts")
    return days, evaluate.batch_mean_squared_error(said, ["ticker", "start_date"], batch)


def chart_tables(inputs: Inputs, labels: DataFrame) -> dict[str, DataFrame]:
    """Series, markers, normalised prices and the label distribution."""
    return {
        "series": charts.chart_series(inputs.stock, inputs.index),
        "markers": charts.chart_markers(labels, inputs.stock),
        "normalized": prices.normalized_prices(inputs.stock, inputs.index),
        "distribution": evaluate.sentiment_distribution(labels),
    }
