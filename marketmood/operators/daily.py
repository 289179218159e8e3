"""One row per ticker and day from many articles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS, NEUTRAL, SENTIMENT_WORDS, recode
from marketmood.functions.text import has_text
from marketmood.storage import small, written

DAY = ["date", "ticker"]

def embed_or_zero(processed: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Each article's vector and text length; none, or no text, gives the zero vector.

    Whether there is text, and its length, are told before the join: the text itself
    does not travel with the vectors. Returns the columns but ``cleaned_text``, with
    ``text_length`` and ``embedding``.
    """
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    text = F.col("cleaned_text")
    narrow = processed.withColumns({"_there": has_text(text), "text_length": F.length(text)}).drop("cleaned_text")
    found = F.coalesce(F.when(F.col("_there"), F.col("embedding")), zero)
    joined = narrow.drop("embedding").join(embeddings.select("news_id", "embedding"), "news_id", "left")
    return joined.withColumn("embedding", found).drop("_there")


def _mean_vector() -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector("embedding")))


def _label() -> Column:
    """An article's label in the library's words; a NULL stays, any unknown word is an error."""
    said = F.col("sentiment")
    return F.coalesce(
        recode(said, {**{l: l for l in LABELS}, **SENTIMENT_WORDS}),
        F.when(said.isNotNull(), F.raise_error(F.concat(F.lit("unknown sentiment: "), said)).cast("string")),
    )


def _most_frequent(counts: dict[str, Column]) -> Column:
    """The label of the highest count, ties to the smallest word; neutral if all are 0."""
    ranked = [F.struct(counts[name].alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("label")) for i, name in enumerate(sorted(LABELS))]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["label"]).otherwise(NEUTRAL)


def _mode() -> Column:
    """Most frequent label, ties to the smallest word, by three counters.

    Labels are the library's words or a user model's positive, neutral and negative; a
    NULL label counts for none, any other word is an error. A day without any label is
    neutral.
    """
    label = _label()
    return _most_frequent({name: F.count_if(label == name) for name in LABELS})


def daily_mean_embedding(articles: DataFrame) -> DataFrame:
    """Element-wise mean vector per day and ticker, merged before the shuffle."""
    return articles.groupBy(*DAY).agg(_mean_vector().alias("embedding"))


def daily_modal_sentiment(articles: DataFrame) -> DataFrame:
    return articles.groupBy(*DAY).agg(_mode().alias("sentiment"))


def daily_text(articles: DataFrame) -> DataFrame:
    """(date, ticker, news_id, position, start, cleaned_text): the layout of a day's joined text.

    The joined text is the day's texts in ``news_id`` order with one blank between them;
    ``start`` counts the characters before a text, ``position`` the texts. A null text is
    empty. Narrow rows are dealt to ranges of (day, id), so a day with a third of the news
    is many ranges; running sums go over the ranges' totals first and then within each.
    The texts themselves move once, to their place. ``articles`` are read twice: pass
    them written. ``news_id`` must identify a row.
    """
    size = F.length(F.coalesce("cleaned_text", F.lit(""))) + 1
    narrow = articles.select(*DAY, "news_id", size.cast("long").alias("_size"))
    ranges = max(2, int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = narrow.repartitionByRange(ranges, *DAY, "news_id").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "day-ranges")
    totals = dealt.groupBy(*DAY, "_range").agg(F.count(F.lit(1)).alias("_texts"), F.sum("_size").alias("_chars"))
    before = Window.partitionBy(*DAY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*DAY, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_texts", "_chars")])
    inside = Window.partitionBy(*DAY, "_range").orderBy("news_id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(small(written(offsets, "offsets")), [*DAY, "_range"]).select(
        "news_id",
        (F.col("_texts") + F.row_number().over(inside) - 1).alias("position"),
        (F.col("_chars") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))).alias("start"),
    )
    texts = articles.select(*DAY, "news_id", F.coalesce("cleaned_text", F.lit("")).alias("cleaned_text"))
    return texts.join(placed, "news_id").select(*DAY, "news_id", "position", "start", "cleaned_text")


def partial_days(articles: DataFrame) -> DataFrame:
    """What a landing adds to its days: vector sum, articles, articles per label, text length.

    Partial days are stored with their landing; ``merge_days`` adds those of several and
    ``finish_days`` gives the rows of ``aggregate_daily`` without reading an article again.
    """
    label = _label()
    return articles.groupBy(*DAY).agg(
        vector_to_array(Summarizer.sum(array_to_vector("embedding"))).alias("vector_sum"),
        F.count(F.lit(1)).alias("n_articles"),
        *[F.count_if(label == name).alias(f"n_{name}") for name in LABELS],
        F.sum(F.coalesce("text_length", F.lit(0))).cast("long").alias("length_sum"),
    )


def merge_days(*partials: DataFrame) -> DataFrame:
    """The partial days of all landings, one row per day; in any order and grouping."""
    rows = reduce(DataFrame.unionByName, partials)
    return rows.groupBy(*DAY).agg(
        vector_to_array(Summarizer.sum(array_to_vector("vector_sum"))).alias("vector_sum"),
        *[F.sum(c).alias(c) for c in ("n_articles", *(f"n_{name}" for name in LABELS), "length_sum")],
    )


def finish_days(days: DataFrame) -> DataFrame:
    """The rows of ``aggregate_daily`` from merged partial days."""
    return days.select(
        *DAY,
        F.transform("vector_sum", lambda x: x / F.col("n_articles")).alias("embedding"),
        _most_frequent({name: F.col(f"n_{name}") for name in LABELS}).alias("sentiment"),
        "n_articles",
        (F.col("length_sum") + F.col("n_articles") - 1).alias("text_length"),
    )


def aggregate_daily(articles: DataFrame) -> DataFrame:
    """Mean vector, modal sentiment, articles and joined length per day and ticker.

    ``articles`` have ``text_length``; the joined text would have one blank between
    texts. One aggregation, always one row per (date, ticker), and no text moves.
    """
    return articles.groupBy(*DAY).agg(
        _mean_vector().alias("embedding"),
        _mode().alias("sentiment"),
        F.count(F.lit(1)).alias("n_articles"),
        (F.sum(F.coalesce("text_length", F.lit(0)) + 1) - 1).alias("text_length"),
    )
