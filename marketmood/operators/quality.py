"""Guards on columns and sizes, and the data quality report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.functions.text import clean_text, has_text, or_empty

MIN_ROWS = 10
MIN_ROWS_BLEND = 20


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Raise before any job runs if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns in {what}: {missing}")
    return df


def require_rows(df: DataFrame, least: int = 1, what: str = "table") -> DataFrame:
    """Raise if there are fewer than ``least`` rows; reads no more than that many."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"{what} too small: {found} rows, need {least}")
    return df


def quality_report(news: DataFrame) -> DataFrame:
    """Per ticker: rows, null titles and descriptions, rows whose text cleans to nothing."""
    text = clean_text(F.concat(or_empty(F.col("title")), F.lit(" "), or_empty(F.col("description"))))
    return (
        news.select(
            "ticker",
            F.col("title").isNull().alias("no_title"),
            F.col("description").isNull().alias("no_description"),
            (~has_text(text)).alias("blank"),
        )
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if("no_title").alias("n_null_title"),
            F.count_if("no_description").alias("n_null_description"),
            F.count_if("blank").alias("n_dropped"),
        )
    )


def null_text_rows(processed: DataFrame) -> DataFrame:
    """Rows of a processed table whose cleaned text is missing."""
    return processed.filter(F.col("cleaned_text").isNull())


def peek(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(order).limit(n)
