"""The data behind the charts, for all tickers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_SERIES = "S&P500 Close"


def chart_series(stock: DataFrame, index: DataFrame) -> DataFrame:
    """Long table (series, date, value): one line per ticker, one for the index.

    The index line is stored once and overlaid on every ticker's chart.
    """
    lines = stock.select(
        F.concat("ticker", F.lit(" Close")).alias("series"), "date", F.col("close").alias("value")
    )
    market = index.select(
        F.lit(INDEX_SERIES).alias("series"), "date", F.col("close").alias("value")
    )
    return lines.unionByName(market)


def chart_markers(labels: DataFrame, stock: DataFrame) -> DataFrame:
    """(ticker, sentiment, date, close): one point per label on a priced date."""
    return labels.select("ticker", "sentiment", "date").join(
        stock.select("ticker", "date", "close"), ["ticker", "date"]
    ).select("ticker", "sentiment", "date", "close")
