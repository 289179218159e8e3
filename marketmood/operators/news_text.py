"""From raw news to one cleaned text per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.functions.text import clean_text, has_text, or_empty
from marketmood.operators.quality import require_columns


def clean_news(news: DataFrame) -> DataFrame:
    """(news_id, date, ticker, cleaned_text) of the rows with text left.

    The test for blank text is made on the one-element array that is unfolded
    into the row. As a filter it would be pushed below the projection and the
    text would be cleaned once more for it, and again for every later filter.
    """
    require_columns(news, ["news_id", "date", "ticker", "title", "description"], "news")
    joined = F.concat(
        or_empty(F.col("title")), F.lit(" "), or_empty(F.col("description"))
    )
    kept = F.filter(F.array(clean_text(joined)), has_text)
    return news.select("news_id", "date", "ticker", F.explode(kept).alias("cleaned_text"))
