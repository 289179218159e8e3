"""News payloads to rows, several sources to one table, and the landing table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketmood.functions.labels import PHRASE_CODES, recode
from marketmood.functions.text import VISIBLE
from marketmood.operators.quality import require_columns
from marketmood.sources.schemas import ARTICLES, NEWS, NEWS_COLUMNS, STORIES
from marketmood.storage import small, written

ARTICLE_SOURCE, FEED_SOURCE = "newsapi", "tickertick"
SOURCES = (ARTICLE_SOURCE, FEED_SOURCE)
TOP_ARTICLES = 100
DAY_MILLIS = 86_400_000
# Company names used in search phrases.
COMPANIES = {
    "AAPL": "Apple Inc",
    "MSFT": "Microsoft Corporation",
    "GOOGL": "Alphabet Inc",
}


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON payloads, one per line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def flatten_articles(payloads: DataFrame) -> DataFrame:
    """``articles[]`` to news rows; missing fields become empty strings."""
    item = payloads.select("ticker", F.explode("articles").alias("a"))
    day = F.substring_index(F.coalesce("a.publishedAt", F.lit("")), "T", 1)
    return item.select(
        day.alias("date"),
        *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("title", "description", "content")],
        "ticker",
        F.lit(ARTICLE_SOURCE).alias("source"),
    )


def flatten_stories(payloads: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """``stories[]`` to news rows within [from, to], both at midnight UTC.

    Days are counted from the epoch, so the session's time zone plays no part.
    """
    first, last = [
        F.unix_date(F.to_date(F.lit(d))).cast("long") * DAY_MILLIS for d in (from_date, to_date)
    ]
    item = payloads.select("ticker", F.explode("stories").alias("s"))
    day = F.date_from_unix_date(F.floor(F.col("s.time") / DAY_MILLIS).cast("int"))
    return item.filter(F.col("s.time").between(first, last)).select(
        day.cast("string").alias("date"),
        *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("title", "description")],
        F.lit("").alias("content"),
        "ticker",
        F.lit(FEED_SOURCE).alias("source"),
    )


def union_sources(
    parts: Sequence[DataFrame],
    tickers: Sequence[str] | None = None,
    sources: Sequence[str] = SOURCES,
) -> DataFrame:
    """All rows of the chosen sources and tickers; a blank date drops a row.

    A missing date is no blank one and stays, as does every duplicate.
    """
    rows = None
    for part in parts:
        require_columns(part, NEWS_COLUMNS, "news")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    keep = F.col("source").isin(list(sources))
    if tickers is not None:
        keep = keep & F.col("ticker").isin(list(tickers))
    day = F.col("date").cast("string")
    return rows.filter(keep & (day.isNull() | day.rlike(VISIBLE)))


def typed(news: DataFrame) -> DataFrame:
    """Cast the date text of a payload to DATE; unparsable text becomes NULL."""
    return news.withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))


def missing_requests(requested: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that are not landed yet."""
    have = landed.select(*keys).distinct()
    return requested.select(*keys).distinct().join(have, list(keys), "left_anti")


LANDED = f"{NEWS}, from_date STRING, to_date STRING"


def land_news(fetched: DataFrame, path: str, from_date: str, to_date: str) -> DataFrame:
    """Land the rows of tickers not landed for this range; return the range's rows.

    Written per range and ticker. Rows are rebalanced by ticker, which packs small
    tickers together and splits a large one over several files. Of what is landed only
    the folders of this range are read. ``news_id`` is a hash of the range and the row,
    with the row's ordinal among equal ones: it never depends on other rows, so a
    repeated task or a later landing gives the same ids.

    Files are staged beside the table, where readers do not look, and a ticker's folder
    is published by one rename that fails if the folder is there. A run that ends early
    leaves whole tickers or none, and of two runs of one range the first to publish a
    ticker lands it. This needs a file system with an atomic rename of folders.
    """
    spark = fetched.sparkSession
    rows = fetched.withColumns({"from_date": F.lit(from_date), "to_date": F.lit(to_date)})
    if _exists(spark, path):
        keys = ["ticker", "from_date", "to_date"]
        landed = _range(spark, path, from_date, to_date)
        rows = rows.join(small(written(missing_requests(rows, landed, keys), "missing")), keys, "left_semi")
    own = ["from_date", "to_date", *NEWS_COLUMNS]
    rows = written(rows.select(*own, F.xxhash64(*own).alias("_key")), "fetched")
    # Equal rows are alike: they are counted, and unfolded to numbered copies again.
    again = written(rows.groupBy("_key").count().filter("count > 1").select("_key"), "again")
    once = rows.join(small(again), "_key", "left_anti").select(*own, F.lit(1).cast("long").alias("_copy"))
    many = rows.join(small(again), "_key", "left_semi").groupBy(*own).count()
    many = many.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("_copy"))
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    (
        once.unionByName(many).withColumn("news_id", F.xxhash64(*own, "_copy"))
        .select("news_id", *NEWS_COLUMNS, "from_date", "to_date")
        .hint("rebalance", "ticker")
        .write.partitionBy("from_date", "to_date", "ticker")
        .parquet(staged)
    )
    _publish(spark, staged, path)
    return _range(spark, path, from_date, to_date).drop("from_date", "to_date")


def _publish(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Rename each staged ticker's folder to its place; the names of those that were free.

    The loop goes over the folders of one landing, a name each; no file passes the driver.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place = hadoop.Path(staged)
    files = place.getFileSystem(conf)
    place = files.makeQualified(place)
    context = hadoop.FileContext.getFileContext(place.toUri(), conf)
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files.mkdirs(hadoop.Path(path))
    done = []
    for found in files.globStatus(hadoop.Path(place, "from_date=*/to_date=*/ticker=*")) or ():
        source = found.getPath()
        folder = hadoop.Path(f"{path}/{source.getParent().getParent().getName()}/{source.getParent().getName()}")
        files.mkdirs(folder)
        target = files.makeQualified(hadoop.Path(folder, source.getName()))
        try:
            context.rename(source, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
        else:
            done.append(target.getName())
    files.delete(place, True)
    return done


def _range(spark: SparkSession, path: str, from_date: str, to_date: str) -> DataFrame:
    """The landed rows of one range; other ranges' folders are pruned."""
    landed = spark.read.schema(LANDED).parquet(path)
    return landed.filter((F.col("from_date") == from_date) & (F.col("to_date") == to_date))


def land_payloads(
    spark: SparkSession,
    articles: str | None,
    stories: str | None,
    path: str,
    from_date: str,
    to_date: str,
    tickers: Sequence[str] | None = None,
) -> DataFrame:
    """Payload folders to landed, typed news: flatten, unite, type the dates, land."""
    parts = []
    if articles is not None:
        parts.append(flatten_articles(read_payloads(spark, articles, ARTICLES)))
    if stories is not None:
        parts.append(flatten_stories(read_payloads(spark, stories, STORIES), from_date, to_date))
    return land_news(typed(union_sources(parts, tickers)), path, from_date, to_date)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception as error:  # no such table yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def top_per_ticker(news: DataFrame, score: str, k: int = TOP_ARTICLES) -> DataFrame:
    """The k most relevant articles of each ticker, ties to the lower id.

    The rank filter is applied per task before the shuffle, so a hot ticker
    sends at most k rows per task.
    """
    order = Window.partitionBy("ticker").orderBy(F.col(score).desc(), "news_id")
    return news.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPANIES.items()), "ticker string, company string")


def company_lookup(tickers: DataFrame, names: DataFrame) -> DataFrame:
    """(ticker, company, search_phrase, feed_ticker); no name falls back to the ticker."""
    company = F.coalesce("company", "ticker")
    return tickers.select("ticker").join(names, "ticker", "left").select(
        "ticker",
        company.alias("company"),
        F.concat_ws(" OR ", "ticker", company).alias("search_phrase"),
        F.lower("ticker").alias("feed_ticker"),
    )


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled phrases from CSV with columns Sentence and Sentiment."""
    return (
        spark.read.schema("Sentence STRING, Sentiment STRING")
        .option("mode", "FAILFAST")
        .csv(path, header=True, multiLine=True, escape='"')
        .withColumnsRenamed({"Sentence": "text", "Sentiment": "sentiment"})
    )


def phrase_labels(phrases: DataFrame, code: str, mapping: dict = PHRASE_CODES) -> DataFrame:
    """Replace a code or word column by ``label``."""
    return phrases.withColumn("label", recode(F.col(code), mapping)).drop(code)
