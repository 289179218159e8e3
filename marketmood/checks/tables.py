"""The library's input tables as views over the driver's tables.

The driver's tables hold no prices and no dated news, so these stand in: bars
come from the events, news from the documents, labelled phrases and the word
tables from the labelled documents. All are derived by Spark and grow with their
source. The same rules are written in SQL in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.text import VECTOR_WORD, vector_words

TICKERS = ("click", "error", "purchase", "signup", "view")
EMBEDDING_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stock_prices(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Daily bars; ``key`` event_type gives 5 tickers, user_id many."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(
            F.col("ts").cast("date").alias("date"), F.col(key).cast("string").alias("ticker")
        )
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("ts").cast("date").alias("date")).agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.round(F.avg("value"), 6).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)")
    place = F.floor(doc_id / 30) % 5
    return docs.select(
        doc_id.alias("news_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 30).cast("int")).alias("date"),
        F.when(doc_id % 17 != 0, first).alias("title"),
        F.when(doc_id % 13 != 0, rest).alias("description"),
        F.lit("").alias("content"),
        F.get(F.array(*[F.lit(t) for t in TICKERS]), place.cast("int")).alias("ticker"),
        F.when(doc_id % 2 == 0, "newsapi").otherwise("tickertick").alias("source"),
        F.col("n_chars").alias("score"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, code) with the codes of the labelled phrase corpus."""
    code = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("doc_id", "text", code.alias("code"))
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, company): each ticker's name is two words of ``benchmark`` items."""
    first = F.regexp_extract(F.lower("text"), VECTOR_WORD, 0)
    place = F.pmod("item_id", F.lit(len(TICKERS))).cast("int")
    return (
        table(spark, sf_dir, "benchmark")
        .groupBy(F.get(F.array(*[F.lit(t) for t in TICKERS]), place).alias("ticker"))
        .agg(F.concat_ws(" ", F.min(first), F.max(first)).alias("company"))
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("news_id"), "embedding"
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, valence) from how often a word occurs in good and in bad phrases."""
    words = phrases(spark, sf_dir).select(
        "code", F.explode(F.array_distinct(vector_words(F.col("text")))).alias("token")
    )
    good, bad = F.col("good"), F.col("bad")
    score = F.floor((good - bad * 6) * 40.0 / (good + bad * 6) + 0.5) / 10.0
    return (
        words.groupBy("token")
        .agg(F.count_if(F.col("code") == 1).alias("good"), F.count_if(F.col("code") == 0).alias("bad"))
        .filter("good + bad >= 2")
        .select("token", score.alias("valence"))
        .filter("valence <> 0")
    )


def modifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, degree, negates) from the words of ``benchmark``."""
    kind = F.length("token") % 3
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(vector_words(F.col("text"))).alias("token"))
        .distinct()
        .select(
            "token",
            F.when(kind == 0, 0.293).when(kind == 1, -0.293).otherwise(0.0).alias("degree"),
            (kind == 2).alias("negates"),
        )
    )
