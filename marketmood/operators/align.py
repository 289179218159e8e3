"""Joins of news with labels and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS
from marketmood.operators.prices import previous_close
from marketmood.storage import small, written

DAY_KEYS = ("date", "ticker")


def align_news_labels(processed: DataFrame, labels: DataFrame) -> DataFrame:
    """Each article with the label of its ticker and date.

    Many articles to one label and no hint: a small label table is broadcast on
    its statistics, a large one is merged and a hot ticker-day is split by
    adaptive execution, label side re-read per piece.
    """
    return (
        processed.dropna(subset=["cleaned_text"])
        .join(labels.select("date", "ticker", "sentiment"), ["date", "ticker"])
    )


def build_features(data: DataFrame, bars: DataFrame) -> DataFrame:
    """Add ``text_length`` (code points) and the ticker's ``previous_close``."""
    return data.withColumn("text_length", F.length("cleaned_text")).join(
        previous_close(bars), ["date", "ticker"], "left"
    )


def training_frame(processed: DataFrame, labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Labels and features in one join of the news.

    Gives what ``build_features(align_news_labels(...))`` gives. Label and
    previous close are joined first, both one row per ticker and day, so the
    texts are matched, and at worst moved, once instead of twice.
    """
    days = labels.select("date", "ticker", "sentiment").join(
        previous_close(bars), ["date", "ticker"], "left"
    )
    return (
        processed.dropna(subset=["cleaned_text"])
        .join(days, ["date", "ticker"])
        .withColumn("text_length", F.length("cleaned_text"))
        .select(*DAY_KEYS, "news_id", "cleaned_text", "sentiment", "text_length", "previous_close")
    )


def join_date_only(processed: DataFrame, labels: DataFrame) -> DataFrame:
    """News joined to labels on the date alone, as counted rows.

    Pairing every article with every ticker of its date multiplies the news by
    the number of tickers, yet the pairs differ only in their label. Labels are
    therefore counted per date first: one row per article and label, with
    ``n_pairs`` telling how many such pairs the plain join holds.
    """
    per_date = labels.groupBy("date").agg(
        *[F.count_if(F.col("sentiment") == label).alias(label) for label in LABELS]
    )
    counted = F.array(
        *[F.struct(F.lit(l).alias("sentiment"), F.col(l).alias("n_pairs")) for l in LABELS]
    )
    return (
        processed.join(small(written(per_date, "labels-per-date")), "date")
        .select("news_id", "date", "cleaned_text", F.inline(counted))
        .filter("n_pairs > 0")
    )
