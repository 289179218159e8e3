"""Returns, previous close, market-relative labels, normalised prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.functions.labels import BAND, band_label
from marketmood.operators.series import with_previous, with_value_before
from marketmood.storage import small, written


def _returns(bars: DataFrame, keys: list[str], column: str, name: str, pad: bool) -> DataFrame:
    # NaN would compare as the largest number; a missing price is NULL.
    bars = bars.withColumn(column, F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))
    if pad:
        filled = with_value_before(bars, keys, "date", F.col(column), "_before")
        now = F.coalesce(F.col(column), F.col("_before"))
    else:
        filled = with_previous(bars, keys, "date", column, "_before")
        now = F.col(column)
    ratio = F.try_divide(now, F.col("_before"))
    return filled.withColumn(name, (ratio - 1) * 100).drop("_before")


def stock_returns(bars: DataFrame, pad: bool = True) -> DataFrame:
    """Percent change of each ticker's close; ``pad`` carries a close over gaps.

    The first row has no return. A zero previous close gives NULL.
    """
    return _returns(
        bars.select("ticker", "date", "close"), ["ticker"], "close", "pct_change", pad
    )


def index_returns(bars: DataFrame, pad: bool = True) -> DataFrame:
    """Percent change of the market index over its own previous row."""
    return _returns(bars.select("date", "close"), [], "close", "pct_change", pad)


def sentiment_labels(
    stock: DataFrame, index: DataFrame, band: float = BAND, pad: bool = True
) -> DataFrame:
    """(date, ticker, sentiment): each return against the index of that date.

    Returns are taken on each series by itself before the dates are joined. A
    missing return compares false both ways and so labels the row neutral.
    """
    stock_side = stock_returns(stock, pad).select(
        "date", "ticker", F.col("pct_change").alias("stock_change")
    )
    index_side = index_returns(index, pad).select(
        "date", F.col("pct_change").alias("index_change")
    )
    return stock_side.join(small(written(index_side, "index-returns")), "date").select(
        "date",
        "ticker",
        band_label(F.col("stock_change"), F.col("index_change"), band).alias("sentiment"),
    )


def previous_close(bars: DataFrame) -> DataFrame:
    """(date, ticker, previous_close): the close of the row before."""
    return with_previous(
        bars.select("ticker", "date", "close"), ["ticker"], "date", "close", "previous_close"
    ).select("date", "ticker", "previous_close")


def normalized_prices(stock: DataFrame, index: DataFrame) -> DataFrame:
    """Stock and index closes over their first value on the common dates.

    The first value is an aggregate per ticker, combined before the shuffle, not
    a window over the whole series.
    """
    market = index.select("date", F.col("close").alias("index_close"))
    both = stock.select("ticker", "date", "close").join(small(market), "date")
    first = both.groupBy("ticker").agg(
        F.min_by("close", "date").alias("_close"),
        F.min_by("index_close", "date").alias("_index_close"),
    )
    return both.join(first, "ticker").select(
        "ticker",
        "date",
        F.try_divide("close", "_close").alias("stock_norm"),
        F.try_divide("index_close", "_index_close").alias("index_norm"),
    )
