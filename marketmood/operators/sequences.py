"""Sliding sequences of daily rows with the close that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.operators.series import with_position
from marketmood.storage import small, written

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
SEQ_LENGTH = 10
_BLOCK = 256


def feature_rows(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, date, features, close): vector and five prices side by side."""
    prices = F.array(*[F.col(c).cast("double") for c in PRICE_COLUMNS])
    vector = F.col("embedding").cast("array<double>")
    return daily.select("ticker", "date", "embedding").join(
        bars.select("ticker", "date", *PRICE_COLUMNS), ["ticker", "date"]
    ).select("ticker", "date", F.concat(vector, prices).alias("features"), "close")


def sequence_blocks(rows: DataFrame, length: int = SEQ_LENGTH) -> DataFrame:
    """(ticker, block, days): each ticker's rows in order, _BLOCK and the next ``length`` to a block.

    ``rows`` are ``feature_rows``; pass them written, they are read twice. Positions are
    numbered on narrow rows; a wide row then moves once, and only the ``length`` first of
    a block stand in two. A window is a place in a block: it starts at one of the block's
    own days, and it and its target lie inside.
    """
    numbered = small(written(with_position(rows.select("ticker", "date"), ["ticker"], "date", "at"), "positions"))
    own = F.floor(F.col("at") / _BLOCK)
    reach = -(-length // _BLOCK)
    inside = F.filter(F.sequence(own - reach, own), lambda b: (b >= 0) & (F.col("at") < (b + 1) * _BLOCK + length))
    placed = rows.join(numbered, ["ticker", "date"]).withColumn("block", F.explode(inside))
    days = F.sort_array(F.collect_list(F.struct("at", "date", "features", "close")))
    return placed.groupBy("ticker", "block").agg(days.alias("days"))


def windows_of(blocks: DataFrame, length: int = SEQ_LENGTH) -> DataFrame:
    """(ticker, start_date, seq, target) of every window of ``sequence_blocks``, unfolded in its row."""
    days = F.col("days")
    starts = F.filter(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), lambda i: i + length < F.size(days))
    window = F.transform(
        starts,
        lambda i: F.struct(
            F.get(days, i)["date"].alias("start_date"),
            F.transform(F.slice(days, i + 1, F.lit(length)), lambda day: day["features"]).alias("seq"),
            F.get(days, i + length)["close"].alias("target"),
        ),
    )
    return blocks.select("ticker", F.inline(window))


def start_dates(blocks: DataFrame, length: int = SEQ_LENGTH) -> DataFrame:
    """(ticker, start_date) of every window, without its rows."""
    starts = F.slice("days", F.lit(1), F.least(F.lit(_BLOCK), F.greatest(F.size("days") - length, F.lit(0))))
    return blocks.select("ticker", F.explode(F.transform(starts, lambda day: day["date"])).alias("start_date"))


def sequence_windows(rows: DataFrame, length: int = SEQ_LENGTH) -> DataFrame:
    """(ticker, start_date, seq, target): n rows of a ticker give n - length windows."""
    return windows_of(sequence_blocks(rows, length), length)
