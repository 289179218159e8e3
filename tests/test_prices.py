from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketmood.operators import align, charts, prices
from marketmood.operators.series import with_position, with_previous, with_value_before

DAY = dt.date(2023, 12, 28)


def days(n, step=1, start=DAY):
    return [start + dt.timedelta(days=i * step) for i in range(n)]


def stock_frame(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def index_frame(spark, rows):
    return spark.createDataFrame(rows, "date date, close double")


def test_returns_match_pandas_over_gaps_and_years(spark):
    closes = [10.0, 11.0, None, None, 12.1, None, 6.05, 6.05]
    dates = days(len(closes), step=250)  # one row, or none, per calendar year
    frame = stock_frame(spark, [("A", d, c) for d, c in zip(dates, closes)])
    got = [r["pct_change"] for r in prices.stock_returns(frame).orderBy("date").collect()]
    filled = pd.Series(closes, dtype=float).ffill()
    want = (filled / filled.shift(1) - 1) * 100
    for g, w in zip(got, want):
        assert (g is None and pd.isna(w)) or g == pytest.approx(w)
    raw = [r["pct_change"] for r in prices.stock_returns(frame, pad=False).orderBy("date").collect()]
    series = pd.Series(closes, dtype=float)
    plain = (series / series.shift(1) - 1) * 100
    for g, w in zip(raw, plain):
        assert (g is None and pd.isna(w)) or g == pytest.approx(w)


def test_previous_keeps_nulls_and_crosses_empty_years(spark):
    rows = [("A", dt.date(2020, 5, 1), 1.0), ("A", dt.date(2020, 5, 2), None),
            ("A", dt.date(2023, 1, 1), 3.0), ("B", dt.date(2021, 1, 1), 9.0)]
    got = {
        (r["ticker"], r["date"].year, r["date"].day): r["previous_close"]
        for r in prices.previous_close(stock_frame(spark, rows)).collect()
    }
    assert got == {("A", 2020, 1): None, ("A", 2020, 2): 1.0, ("A", 2023, 1): None, ("B", 2021, 1): None}


def test_value_before_and_position_without_keys(spark):
    rows = [(d, float(i)) for i, d in enumerate(days(9, step=100))]
    frame = index_frame(spark, rows)
    got = with_value_before(frame, [], "date", F.col("close"), "p").orderBy("date").collect()
    assert [r["p"] for r in got] == [None] + [float(i) for i in range(8)]
    at = with_position(frame, [], "date", "n").orderBy("date").collect()
    assert [r["n"] for r in at] == list(range(9))
    prev = with_previous(frame, [], "date", "close", "p").orderBy("date").collect()
    assert [r["p"] for r in prev] == [None] + [float(i) for i in range(8)]


def test_labels(spark):
    d = days(4)
    stock = stock_frame(
        spark,
        [("A", d[0], 100.0), ("A", d[1], 100.5), ("A", d[2], 100.5 * 1.02), ("A", d[3], 90.0),
         ("B", d[0], 50.0), ("B", d[2], 50.0), ("B", dt.date(2030, 1, 1), 70.0),
         ("Z", d[0], 0.0), ("Z", d[1], 5.0)],
    )
    index = index_frame(spark, [(x, 200.0) for x in d])
    got = {
        (r["ticker"], r["date"]): r["sentiment"]
        for r in prices.sentiment_labels(stock, index).collect()
    }
    assert got == {
        ("A", d[0]): "neutral",  # first row, no return, kept
        ("A", d[1]): "neutral",  # index + 0.5, comparison is strict
        ("A", d[2]): "bullish",
        ("A", d[3]): "bearish",
        ("B", d[0]): "neutral",
        ("B", d[2]): "neutral",
        ("Z", d[0]): "neutral",
        ("Z", d[1]): "neutral",  # zero close before: no return
    }  # and no row for the date the index lacks


def test_features_keep_rows_without_price(spark):
    d = days(2)
    data = spark.createDataFrame(
        [(1, d[1], "A", "naïve café"), (2, d[0], "A", "x"), (3, d[0], "C", "yy")],
        "news_id long, date date, ticker string, cleaned_text string",
    )
    bars = stock_frame(spark, [("A", d[0], 4.0), ("A", d[1], 5.0)])
    got = {
        r["news_id"]: (r["text_length"], r["previous_close"])
        for r in align.build_features(data, bars).collect()
    }
    assert got == {1: (10, 4.0), 2: (1, None), 3: (2, None)}


def test_date_only_join_counts_every_pair(spark):
    d = days(2)
    news = spark.createDataFrame(
        [(1, d[0], "A", "x"), (2, d[0], "B", "y"), (3, d[1], "A", "z")],
        "news_id long, date date, ticker string, cleaned_text string",
    )
    labels = spark.createDataFrame(
        [(d[0], "A", "bullish"), (d[0], "B", "bullish"), (d[0], "C", "neutral")],
        "date date, ticker string, sentiment string",
    )
    got = align.join_date_only(news, labels)
    pairs = news.drop("ticker").join(labels, "date").groupBy("news_id", "sentiment").count()
    assert {tuple(r) for r in got.select("news_id", "sentiment", "n_pairs").collect()} == {
        tuple(r) for r in pairs.collect()
    }


def test_charts_and_normalised_prices(spark):
    d = days(3)
    stock = stock_frame(spark, [("A", d[0], 8.0), ("A", d[1], 10.0), ("A", d[2], 15.0)])
    index = index_frame(spark, [(d[1], 4.0), (d[2], 5.0)])
    labels = spark.createDataFrame(
        [(d[1], "A", "bullish"), (dt.date(2031, 1, 1), "A", "bearish")],
        "date date, ticker string, sentiment string",
    )
    norm = {r["date"]: (r["stock_norm"], r["index_norm"])
            for r in prices.normalized_prices(stock, index).collect()}
    assert norm == {d[1]: (1.0, 1.0), d[2]: (1.5, 1.25)}
    assert [tuple(r) for r in charts.chart_markers(labels, stock).collect()] == [
        ("A", "bullish", d[1], 10.0)
    ]
    lines = charts.chart_series(stock, index).groupBy("series").count().collect()
    assert {tuple(r) for r in lines} == {("A Close", 3), ("S&P500 Close", 2)}
