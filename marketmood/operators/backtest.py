"""Signals of a day, and return and Sharpe ratio of a series of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.operators.series import with_previous

INITIAL_CASH = 10000.0
TRADING_DAYS = 252


def first_signal_per_day(predictions: DataFrame) -> DataFrame:
    """(ticker, date, signal): the prediction of the day's first article.

    An aggregate, so a hot ticker-day shrinks to one row per task before the
    shuffle.
    """
    return predictions.groupBy("ticker", "date").agg(
        F.min_by("prediction", "news_id").alias("signal")
    )


def common_dates(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Distinct (ticker, date) found on both sides."""
    return signals.select("ticker", "date").intersect(bars.select("ticker", "date"))


def holding_value(bars: DataFrame, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """(ticker, date, portfolio): the value of holding a ticker from its first close on."""
    first = bars.groupBy("ticker").agg(F.min_by("close", "date").alias("_first"))
    value = F.try_divide(F.col("close"), F.col("_first")) * initial_cash
    return bars.join(first, "ticker").select("ticker", "date", value.alias("portfolio"))


def backtest_metrics(portfolio: DataFrame, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """(ticker, total_return, sharpe_ratio).

    Fewer than two days give 0 for both, no variation a Sharpe ratio of 0, one
    single return a NULL one.
    """
    returns = with_previous(portfolio, ["ticker"], "date", "portfolio", "_before").withColumn(
        "_return", F.try_divide("portfolio", "_before") - 1
    )
    sums = returns.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("portfolio", "date").alias("_last"),
        F.avg("_return").alias("_mean"),
        F.stddev_samp("_return").alias("_std"),
    )
    short = F.col("_n") < 2
    return sums.select(
        "ticker",
        F.when(short, 0.0).otherwise(F.col("_last") / initial_cash - 1).alias("total_return"),
        F.when(short | (F.col("_std") == 0), 0.0)
        .otherwise(F.col("_mean") / F.col("_std") * math.sqrt(TRADING_DAYS))
        .alias("sharpe_ratio"),
    )
