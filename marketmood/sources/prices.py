"""Readers of daily bars and of the market index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.sources.schemas import INDEX, STOCK

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def nan_to_null(df: DataFrame, columns: Sequence[str] = BAR_COLUMNS[:4]) -> DataFrame:
    """NaN would compare as the largest number; a missing price is NULL."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def _in_range(start: str | None, end: str | None) -> Column:
    """Start inclusive, end exclusive."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        keep = keep & (F.col("date") < F.to_date(F.lit(end)))
    return keep


def stock_bars(
    bars: DataFrame,
    tickers: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """The seven bar columns of the chosen tickers in [start, end)."""
    keep = _in_range(start, end)
    if tickers is not None:
        keep = keep & F.col("ticker").isin(list(tickers))
    return bars.filter(keep).select("date", "ticker", *BAR_COLUMNS)


def index_bars(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return bars.filter(_in_range(start, end)).select("date", *BAR_COLUMNS)


def read_bars(spark: SparkSession, path: str, market: bool = False, fmt: str = "parquet") -> DataFrame:
    """Bars from Parquet or CSV under a declared schema, NaN as NULL."""
    reader = spark.read.schema(INDEX if market else STOCK)
    if fmt == "csv":
        table = reader.option("mode", "FAILFAST").csv(path, header=True)
    else:
        table = reader.parquet(path)
    return nan_to_null(table)
