"""Relevance of articles to a ticker's search phrase: an inverted index in impact blocks.

The index holds, per ticker and word, the articles with the word and their BM25 part for
it (term frequency against length, in whole micro-units), in blocks of about BLOCK
articles of one impact level, each with its lowest and highest part.

A search knows from the blocks' sizes and bounds alone what the k-th article of a ticker
scores at least. A block in which even the best article could not reach that, if it had
every other word of the phrase at its highest, is not read. What is read is complete for
every article that can be among the k best, so one sum and one top-k end the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.functions.text import counted, vector_words
from marketmood.sources.news import TOP_ARTICLES, top_per_ticker
from marketmood.storage import in_pieces, small, written

# Saturation and length weight of BM25, as commonly set.
K1, B = 1.2, 0.75
MICRO = 1_000_000
# Impact levels of a word's articles, from 0 to the highest part there is.
LEVELS = 64
BLOCK = 128
# The word every article carries; it counts articles and their lengths.
_ANY = ""
_WORD = ["ticker", "token"]


def _part(n: Column, length: Column, mean: float) -> Column:
    """How much of its highest possible weight a word has in an article."""
    saturated = n + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean))
    return F.floor(F.lit(MICRO * (K1 + 1)) * n / saturated).cast("long")


def index_articles(articles: DataFrame, text: str, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, frequencies) of (ticker, news_id, text) articles; both are written.

    With ``words`` (token) only those are indexed, which is what a search for known
    phrases needs. A word's frequency counts all articles, of whatever ticker. An article
    without words, or with none of ``words``, is counted and in no block.
    """
    listed = vector_words(F.col(text))
    own = ["ticker", "news_id", "length"]
    rows = articles.select(*own[:2], F.size(listed).alias("length"), F.array_append(listed, F.lit(_ANY)).alias("_words"))
    if words is None:
        rows = rows.select(*own, F.inline(counted(F.col("_words"))))
    else:
        # Most words meet nothing, so they are counted after the join, by task before the shuffle.
        wanted = words.select("token").unionByName(articles.sparkSession.createDataFrame([(_ANY,)], "token string")).distinct()
        met = in_pieces(rows.select(*own, F.explode("_words").alias("token")), written(wanted, "index-words"), "token", "left_semi")
        rows = met.groupBy(*own, "token").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "occurrences")
    frequencies = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
    frequencies = written(frequencies, "frequencies")
    whole = frequencies.filter(F.col("token") == _ANY).first()
    mean = (whole["length"] / whole["df"] if whole else 0.0) or 1.0
    part = _part(F.col("n"), F.col("length"), mean)
    level = F.floor(F.col("part") * LEVELS / F.lit(int(MICRO * (K1 + 1)) + 1)).cast("int")
    parts = rows.filter((F.col("token") != _ANY) & F.col("ticker").isNotNull()).withColumn("part", part).withColumn("level", level)
    place = [*_WORD, "level"]
    sizes = small(written(parts.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes"))
    blocks = parts.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("news_id"), F.col("blocks")))
    posting = F.struct("part", "news_id")
    return (
        written(
            blocks.groupBy(*place, "block").agg(
                F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"), F.collect_list(posting).alias("postings")
            ),
            "blocks",
        ),
        frequencies,
    )


def _weights(frequencies: DataFrame) -> DataFrame:
    """(token, weight): ln(1 + (N - df + 1/2) / (df + 1/2)) in whole micro-units."""
    whole = frequencies.filter(F.col("token") == _ANY).first()
    rarity = F.ln(1 + (F.lit(float(whole["df"] if whole else 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return frequencies.filter(F.col("token") != _ANY).select("token", F.floor(MICRO * rarity).cast("long").alias("weight"))


def needed_levels(blocks: DataFrame, weights: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """(ticker, token, level, weight, others, least) of the levels a search has to read.

    ``least`` is a score that k articles of the ticker reach with one word of the phrase
    alone; ``others`` is what the phrase's other words can add at most.
    """
    levels = blocks.groupBy(*_WORD, "level").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    asked = phrases.select(*_WORD).distinct().join(weights, "token")
    levels = levels.join(small(written(asked, "asked")), _WORD)
    downwards = Window.partitionBy(*_WORD).orderBy(F.desc("level"))
    ticker = Window.partitionBy("ticker")
    enough = F.sum("n").over(downwards) >= k
    levels = levels.withColumns({"reached": F.when(enough, F.col("weight") * F.col("low")), "top": F.max(F.col("weight") * F.col("high")).over(Window.partitionBy(*_WORD))})
    # A word's top counts once, at its highest level.
    first = F.row_number().over(downwards) == 1
    levels = levels.withColumn("once", F.when(first, F.col("top")).otherwise(0))
    levels = levels.withColumns({"least": F.coalesce(F.max("reached").over(ticker), F.lit(0)), "others": F.sum("once").over(ticker) - F.col("top")})
    return levels.filter(F.col("weight") * F.col("high") + F.col("others") >= F.col("least")).select(*_WORD, "level", "weight", "others", "least")


def search_articles(blocks: DataFrame, frequencies: DataFrame, phrases: DataFrame, k: int = TOP_ARTICLES) -> DataFrame:
    """(ticker, rank, news_id, score): each ticker's k articles most relevant to its phrase.

    ``phrases`` has a row per (ticker, token). The score is the BM25 sum over the
    phrase's distinct words; articles with none of them are not found. Equal scores go by
    ``news_id``.
    """
    levels = needed_levels(blocks, _weights(frequencies), phrases, k)
    read = blocks.join(small(written(levels, "levels")), [*_WORD, "level"])
    read = read.filter(F.col("weight") * F.col("high") + F.col("others") >= F.col("least"))
    parts = read.select("ticker", "weight", F.inline("postings"))
    scored = parts.groupBy("ticker", "news_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
    ranked = top_per_ticker(scored.filter("score > 0"), "score", k)
    return ranked.select("ticker", "rank", "news_id", (F.col("score") / float(MICRO) / float(MICRO)).alias("score"))


def phrase_words(companies: DataFrame) -> DataFrame:
    """(ticker, token): the words of "ticker OR company", without the operator."""
    words = vector_words(F.concat_ws(" ", "ticker", "company"))
    return companies.select("ticker", F.explode(F.array_distinct(words)).alias("token"))


def most_relevant(articles: DataFrame, companies: DataFrame, text: str, k: int = TOP_ARTICLES) -> DataFrame:
    """The k articles of each ticker most relevant to its ticker and company name.

    ``companies`` is (ticker, company), as ``company_lookup`` gives it.
    """
    phrases = written(phrase_words(companies), "phrases")
    blocks, frequencies = index_articles(articles, text, phrases)
    return search_articles(blocks, frequencies, phrases, k)
