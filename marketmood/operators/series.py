"""Values and positions along a series of daily rows.

A series is a ticker's days, or the market's: its length is bounded by the calendar
(some 250 rows a year), so one window per series is one exchange of bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def with_value_before(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` on an earlier row of the series."""
    earlier = _series(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(earlier))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, column: str, name: str
) -> DataFrame:
    """Add ``name``: ``column`` of the row before, as ``shift(1)`` per series."""
    return df.withColumn(name, F.lag(column).over(_series(keys, order)))


def with_position(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Add ``name``: the 0-based position of the row in its series."""
    return df.withColumn(name, (F.row_number().over(_series(keys, order)) - 1).cast("long"))
