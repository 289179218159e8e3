"""Schemas of all input tables; nothing is inferred."""

from __future__ import annotations

_BAR = "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"

NEWS_COLUMNS = ("date", "title", "description", "content", "ticker", "source")
NEWS = (
    "news_id BIGINT, date DATE, title STRING, description STRING, content STRING, "
    "ticker STRING, source STRING"
)
STOCK = f"date DATE, ticker STRING, {_BAR}"
INDEX = f"date DATE, {_BAR}"
ARTICLES = (
    "ticker STRING, articles ARRAY<STRUCT<publishedAt: STRING, title: STRING, "
    "description: STRING, content: STRING>>"
)
STORIES = (
    "ticker STRING, stories ARRAY<STRUCT<time: BIGINT, title: STRING, description: STRING>>"
)
BLEND = "pos_thresh DOUBLE, weight DOUBLE"
BACKTEST = "total_return DOUBLE, sharpe_ratio DOUBLE, ticker STRING"
