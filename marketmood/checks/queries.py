"""One query per operator, each over the whole tables.

Numbers are rounded here, not in the operators, so that both engines agree on
every digit that is compared; arrays are laid out as rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood import storage
from marketmood.checks import tables as t
from marketmood.functions.labels import LABEL_INDEX, LABELS, SENTIMENT_WORDS, recode
from marketmood.operators import (
    align,
    backtest,
    bayes,
    blend,
    charts,
    daily,
    evaluate,
    forecast,
    learned,
    lexicon,
    news_text,
    prices,
    quality,
    relevance,
    sequences,
    split,
    staged,
)
from marketmood.plans import models
from marketmood.sources import news as news_source
from marketmood.sources import prices as price_source
from marketmood.sources import sinks
from marketmood.sources.schemas import ARTICLES, STORIES

# The check's own model runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

RANGE = ("2024-01-05", "2024-01-20")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double; adding 0.0 turns a negative zero into zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


# Inputs shared by several queries.


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return prices.sentiment_labels(t.stock_prices(spark, d), t.index_prices(spark, d))


def _processed(spark: SparkSession, d: str) -> DataFrame:
    return news_text.clean_news(t.news(spark, d))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.align_news_labels(_processed(spark, d), _labels(spark, d))


def _general(spark: SparkSession, d: str) -> DataFrame:
    return news_source.phrase_labels(t.phrases(spark, d), "code").select("text", "label")


def _specific(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("cleaned_text").alias("text"), F.col("sentiment").alias("label"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """Aligned news with ``is_test``, written: fitting and scoring both read it."""
    return storage.written(split.hash_split(_aligned(spark, d), ["news_id"]), "aligned")


KEEP = ["news_id", "date", "ticker", "sentiment", "is_test"]


def _bayes_scores(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    rows = _split(spark, d) if rows is None else rows
    model = bayes.fit(_specific(rows.filter("NOT is_test")), _general(spark, d))
    return bayes.joint_scores(rows, model, KEEP, "cleaned_text")


def _bayes_predictions(spark: SparkSession, d: str) -> DataFrame:
    return bayes.predict(_bayes_scores(spark, d))


def _members(spark: SparkSession, d: str, chosen: str = "true") -> DataFrame:
    """Learned probabilities and lexicon polarity of the aligned articles chosen."""
    rows = _split(spark, d)
    model = bayes.fit(_specific(rows.filter("NOT is_test")), _general(spark, d))
    asked = rows.filter(chosen)
    scores = bayes.joint_scores(asked, model, KEEP, "cleaned_text")
    learned_side = rounded(bayes.predict_proba(scores), 4)
    return learned_side.join(_scored(spark, d, asked, ["news_id"]), "news_id")


def _scored(spark: SparkSession, d: str, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Polarity under the stand-in word tables, which are written as inputs are."""
    words = storage.written(t.lexicon(spark, d), "lexicon")
    modifiers = storage.written(t.modifier_words(spark, d), "modifiers")
    return lexicon.polarity(docs, words, keep, modifier_words=modifiers)


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Aligned news with a vector each."""
    return daily.embed_or_zero(_aligned(spark, d), t.embeddings(spark, d), t.EMBEDDING_DIM)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return backtest.first_signal_per_day(_bayes_predictions(spark, d))


# Prices and labels.


@query
def stock_returns(spark, d):
    return rounded(prices.stock_returns(t.stock_prices(spark, d, "user_id")))


@query
def index_returns(spark, d):
    return rounded(prices.index_returns(t.index_prices(spark, d)))


@query
def previous_close(spark, d):
    return rounded(prices.previous_close(t.stock_prices(spark, d, "user_id")))


@query
def sentiment_labels(spark, d):
    return prices.sentiment_labels(t.stock_prices(spark, d, "user_id"), t.index_prices(spark, d))


@query
def normalized_prices(spark, d):
    return rounded(
        prices.normalized_prices(t.stock_prices(spark, d, "user_id"), t.index_prices(spark, d))
    )


@query
def stock_bars(spark, d):
    return rounded(
        price_source.stock_bars(
            price_source.nan_to_null(t.stock_prices(spark, d)), ["click", "view"], *RANGE
        )
    )


@query
def index_bars(spark, d):
    return rounded(price_source.index_bars(t.index_prices(spark, d), *RANGE))


@query
def null_closes(spark, d):
    """Returns of days whose last known close is some days old: every fifth close is missing."""
    stock = t.stock_prices(spark, d, "user_id")
    missing = F.pmod(F.dayofmonth("date"), F.lit(5)) == 0
    return rounded(prices.stock_returns(stock.withColumn("close", F.when(~missing, F.col("close")))))


@query
def bars_by_ticker(spark, d):
    """Bars written by ticker, one ticker written again, and the index, all read back."""
    stocks, market = storage.new_path(spark, "bars"), storage.new_path(spark, "market")
    bars = t.stock_prices(spark, d)
    sinks.write_by_ticker(bars, stocks)
    sinks.write_by_ticker(bars.filter("ticker = 'view'").withColumn("volume", F.lit(0).cast("long")), stocks)
    sinks.write_table(t.index_prices(spark, d), market)
    columns = ["ticker", "date", "close", "volume"]
    index = sinks.read_table(spark, market).withColumn("ticker", F.lit("index"))
    return rounded(sinks.read_table(spark, stocks).select(*columns).unionByName(index.select(*columns)))


@query
def processed_files(spark, d):
    """Processed news and labels written by ticker, read back and joined."""
    news_path, label_path = storage.new_path(spark, "processed"), storage.new_path(spark, "labels")
    sinks.write_by_ticker(_processed(spark, d), news_path)
    sinks.write_by_ticker(_labels(spark, d), label_path)
    return align.align_news_labels(sinks.read_table(spark, news_path), sinks.read_table(spark, label_path))


# News sources.


def _payload_lines(spark: SparkSession, d: str, source: str) -> DataFrame:
    """News rows in pages of at most 100 ids of one ticker."""
    page = [F.col("ticker"), F.floor(F.col("news_id") / 100).alias("_page")]
    return t.news(spark, d).filter(F.col("source") == source).groupBy(*page)


@query
def news_articles_flatten(spark, d):
    payloads = _payload_lines(spark, d, "newsapi").agg(
        F.collect_list(
            F.struct(
                F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T08:30:00Z")).alias("publishedAt"),
                "title",
                "description",
            )
        ).alias("articles")
    )
    path = storage.new_path(spark, "articles")
    payloads.select("ticker", "articles").write.json(path)
    return news_source.flatten_articles(news_source.read_payloads(spark, path, ARTICLES))


@query
def news_feed_range(spark, d):
    quarter = (F.floor(F.col("news_id") / 2) % 4) * 21_600_000
    payloads = _payload_lines(spark, d, "tickertick").agg(
        F.collect_list(
            F.struct(
                (F.unix_date("date").cast("long") * 86_400_000 + quarter).alias("time"),
                "title",
                "description",
            )
        ).alias("stories")
    )
    path = storage.new_path(spark, "stories")
    payloads.select("ticker", "stories").write.json(path)
    return news_source.flatten_stories(news_source.read_payloads(spark, path, STORIES), *RANGE)


@query
def news_union_sources(spark, d):
    rows = t.news(spark, d).withColumn(
        "date",
        F.when(F.col("news_id") % 11 == 0, F.lit(" \t"))
        .when(F.col("news_id") % 19 != 0, F.date_format("date", "yyyy-MM-dd")),
    ).drop("score")
    parts = [rows.filter(F.col("source") == s) for s in news_source.SOURCES]
    return news_source.union_sources(parts, ["click", "error", "view"]).select(
        "news_id", "date", "title", "description", "content", "ticker", "source"
    )


@query
def news_missing_keys(spark, d):
    requested = t.stock_prices(spark, d).select(
        "ticker", "date", F.explode(F.array(*[F.lit(s) for s in news_source.SOURCES])).alias("source")
    )
    return news_source.missing_requests(requested, t.news(spark, d), ["ticker", "date", "source"])


@query
def news_top_per_ticker(spark, d):
    """The articles most relevant to "ticker OR company", from an index in impact blocks."""
    names = news_source.company_lookup(t.news(spark, d).select("ticker").distinct(), t.companies(spark, d))
    articles = t.news(spark, d).withColumn("text", F.concat_ws(" ", "title", "description"))
    return rounded(relevance.most_relevant(articles, names, "text"))


@query
def company_lookup(spark, d):
    suppliers = t.table(spark, d, "supplier")
    names = (
        suppliers.filter("s_acctbal > 0")
        .join(t.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_name").alias("ticker"), F.col("n_name").alias("company"))
    )
    return news_source.company_lookup(suppliers.select(F.col("s_name").alias("ticker")), names)


@query
def phrasebank_labels(spark, d):
    return (
        news_source.phrase_labels(t.phrases(spark, d), "code")
        .withColumn("label_index", recode(F.col("label"), LABEL_INDEX))
        .select("doc_id", "text", "label", "label_index")
    )


@query
def phrases_from_csv(spark, d):
    """The phrase corpus as a CSV file of sentences and words, read and renamed."""
    path = storage.new_path(spark, "phrases")
    words = F.when(F.col("code") == 0, "negative").when(F.col("code") == 1, "positive").otherwise("neutral")
    rows = t.phrases(spark, d).select(F.col("text").alias("Sentence"), words.alias("Sentiment"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return news_source.phrase_labels(news_source.read_phrases(spark, path), "sentiment", SENTIMENT_WORDS).select("text", "label")


# Text.


@query
def clean_news(spark, d):
    return _processed(spark, d)


@query
def quality_report(spark, d):
    return quality.quality_report(t.news(spark, d))


@query
def news_peek(spark, d):
    return quality.peek(_processed(spark, d), "news_id")


@query
def align_news_labels(spark, d):
    return _aligned(spark, d)


@query
def build_features(spark, d):
    return rounded(align.build_features(_aligned(spark, d), t.stock_prices(spark, d)))


@query
def training_frame(spark, d):
    return rounded(
        align.training_frame(_processed(spark, d), _labels(spark, d), t.stock_prices(spark, d))
    )


@query
def join_date_only(spark, d):
    return align.join_date_only(_processed(spark, d), _labels(spark, d)).select(
        "news_id", "date", "sentiment", "n_pairs"
    )


@query
def sentiment_distribution(spark, d):
    return evaluate.sentiment_distribution(
        prices.sentiment_labels(t.stock_prices(spark, d, "user_id"), t.index_prices(spark, d))
    )


# Splits.


@query
def split_hash(spark, d):
    return split.hash_split(t.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query
def split_exact(spark, d):
    return split.exact_split(t.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query
def split_stratified(spark, d):
    rows = news_source.phrase_labels(t.phrases(spark, d), "code").select("doc_id", "label")
    return split.exact_split(rows, ["doc_id"], strata="label")


@query
def split_time(spark, d):
    return split.time_split(t.stock_prices(spark, d, "user_id").select("ticker", "date"), "date")


# Naive Bayes and TF-IDF.


@query
def bow_counts(spark, d):
    docs = t.news(spark, d).withColumn("text", F.concat_ws(" ", "title", "description"))
    known = storage.written(bayes.vocabulary(_general(spark, d), "text"), "vocabulary")
    return bayes.bow_counts(docs, known, "news_id", "text")


@query
def nb_fit(spark, d):
    return rounded(bayes.fit(_specific(_aligned(spark, d)), _general(spark, d)))


@query
def nb_continued(spark, d):
    """A model of the general corpus, saved, loaded and continued with the articles in two
    parts: the same weights as one fit."""
    rows = storage.written(_aligned(spark, d), "aligned")
    model = models.BayesModel().start(_general(spark, d))
    for part in (0, 1):
        path = storage.new_path(spark, "bayes")
        model.save(path)
        model = models.BayesModel().load(spark, path).train_more(rows.filter(F.pmod("news_id", F.lit(2)) == part))
    return rounded(model.weights)


@query
def nb_predict(spark, d):
    return _bayes_predictions(spark, d).select("news_id", "sentiment", "is_test", "prediction")


@query
def nb_proba(spark, d):
    shares = bayes.predict_proba(_bayes_scores(spark, d))
    return rounded(shares.select("news_id", *LABELS))


@query
def tfidf(spark, d):
    docs = t.phrases(spark, d).select("doc_id", "text")
    idf = storage.written(bayes.inverse_document_frequency(docs, "text"), "idf")
    return rounded(bayes.tfidf(docs, idf, ["doc_id"], "text"))


@query
def tfidf_nb(spark, d):
    rows = storage.written(
        split.hash_split(
            news_source.phrase_labels(t.phrases(spark, d), "code"), ["doc_id"]
        ),
        "phrases",
    )
    model = bayes.fit_tfidf(rows.filter("NOT is_test"))
    scores = bayes.joint_scores_tfidf(rows.filter("is_test"), model, ["doc_id", "label"], "text")
    return bayes.predict(rounded(scores))


# Lexicon polarity.


def _polarity(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, _processed(spark, d), ["news_id", "date", "ticker"])


@query
def lexicon_polarity(spark, d):
    return _polarity(spark, d)


@query
def lexicon_predict(spark, d):
    return lexicon.predict(_polarity(spark, d)).select("news_id", "prediction")


@query
def lexicon_proba(spark, d):
    return rounded(lexicon.predict_proba(_polarity(spark, d)).select("news_id", *LABELS))


# Learned members and the blend.


@query
def softmax_argmax(spark, d):
    scores = _bayes_scores(spark, d).select("news_id", *LABELS)
    shares = learned.from_logits(scores, {l: l for l in LABELS})
    return rounded(shares.select("news_id", *LABELS, "prediction"))


@query
def blend_predict(spark, d):
    return rounded(
        blend.blend_predict(_members(spark, d)).select("news_id", *LABELS, "prediction")
    )


@query
def blend_grid_search(spark, d):
    members = _members(spark, d, "is_test")
    return rounded(blend.blend_best(blend.blend_grid(members, "sentiment")))


# Places of hashed words, and rounds of each stage's descent.
HASHED, ROUNDS = 1 << 14, 8


def _regression(rows: DataFrame, general: DataFrame) -> tuple[staged.Regression, staged.Regression]:
    """The model of the general corpus, and what the specific training rows make of it."""
    first = staged.fit(general, None, HASHED, ROUNDS)
    return first, staged.fit(_specific(rows.filter("NOT is_test")), first, HASHED, ROUNDS)


def _learned(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d)
    _, model = _regression(rows, _general(spark, d))
    return staged.predict(rows.filter("is_test"), model, ["news_id", "sentiment"], "cleaned_text")


@query
def learned_predict(spark, d):
    """Probabilities and prediction of a fitted model: no SQL form, see the invariants."""
    return _learned(spark, d)


@query
def learned_invariants(spark, d):
    """Per label how many articles there are, how many have shares that sum to one, and how
    many have the label of the highest share."""
    best = F.greatest(*LABELS)
    chosen = F.coalesce(*[F.when(F.col("prediction") == l, F.col(l)) for l in LABELS])
    return _learned(spark, d).groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(sum((F.col(l) for l in LABELS), F.lit(0.0)) - 1) < 1e-9).alias("n_summing_to_one"),
        F.count_if(chosen == best).alias("n_best"),
    )


@query
def learned_stages(spark, d):
    """Log likelihood of held-out specific rows after the general stage and after both."""
    rows = _split(spark, d)
    parts = [
        staged.log_likelihood(staged.predict(rows.filter("is_test"), model, ["news_id", "sentiment"], "cleaned_text"), "sentiment").select(
            F.lit(name).alias("stage"), "n", "log_likelihood"
        )
        for name, model in zip(("general", "specific"), _regression(rows, _general(spark, d)))
    ]
    return parts[0].unionByName(parts[1])


class LetterModel:
    """A model without weights: a token's vector is its length, the place of its first letter
    and whether its length is even; the label follows the lengths' remainders."""

    labels = LABELS

    def tokens(self, text):
        return [len(w) * 8 + ord(w[0]) % 7 + 1 for w in text.split(" ") if w]

    def __call__(self, ids, mask):
        lengths = ids // 8
        vectors = np.stack([lengths, ids % 8 - 1, lengths % 2 == 0], axis=2).astype("float32")
        hits = (lengths[:, :, None] % len(LABELS) == np.arange(len(LABELS))) & mask[:, :, None]
        return vectors, hits.sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]


@query
def infer_pooled(spark, d):
    """Token vectors of whole texts in batches of like length, pooled to one vector a text."""
    rows = learned.infer_pooled(_processed(spark, d), LetterModel, 3, chunk_tokens=256, batch_tokens=4096)
    return rounded(
        rows.select("news_id", "sentiment", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double")), 5
    )


@query
def model_by_name(spark, d):
    """A model made by its name, trained, saved, made again and loaded: what it says of the articles."""
    rows = _split(spark, d)
    path = storage.new_path(spark, "model")
    models.get_model("naive_bayes").train(rows.filter("NOT is_test"), _general(spark, d)).save(path)
    return models.get_model("naive_bayes").load(spark, path).predict(rows, ("news_id", "sentiment", "is_test"))


# Evaluation.


@query
def eval_metrics(spark, d):
    tested = _bayes_predictions(spark, d).filter("is_test")
    return rounded(evaluate.eval_metrics(tested, "sentiment"), 4)


@query
def confusion_matrix(spark, d):
    tested = _bayes_predictions(spark, d).filter("is_test")
    return evaluate.confusion_matrix(tested, "sentiment")


@query
def metrics_files(spark, d):
    """The metrics row as JSON and as text with four decimals, both read back."""
    metrics = evaluate.eval_metrics(_bayes_predictions(spark, d).filter("is_test"), "sentiment")
    folder, text = storage.new_path(spark, "metrics"), storage.new_path(spark, "metrics-text")
    sinks.write_metrics(metrics, folder)
    sinks.write_metrics_text(metrics, "Model", text)
    lines = spark.read.text(text, wholetext=True).filter("value <> ''").select(F.regexp_replace("value", "\n$", "").alias("lines"))
    stored = spark.read.schema("n long, accuracy double, precision double, recall double, f1 double").json(folder)
    return rounded(stored.join(lines), 4)


@query
def blend_parameters(spark, d):
    """The tuned setting, written as JSON and read back."""
    path = storage.new_path(spark, "blend")
    sinks.write_blend(blend.blend_best(blend.blend_grid(_members(spark, d, "is_test"), "sentiment")), path)
    found = spark.createDataFrame([sinks.read_blend(spark, path)], "pos_thresh double, weight double")
    return rounded(found)


# Daily aggregates and sequences.


@query
def embed_or_zero(spark, d):
    rows = _articles(spark, d).select("news_id", F.posexplode("embedding").alias("pos", "x"))
    return rounded(rows.select("news_id", "pos", F.col("x").cast("double").alias("x")))


@query
def daily_mean_embedding(spark, d):
    rows = daily.daily_mean_embedding(_articles(spark, d))
    return rounded(rows.select("date", "ticker", F.posexplode("embedding").alias("pos", "x")))


@query
def daily_modal_sentiment(spark, d):
    scored = lexicon.predict(_polarity(spark, d)).withColumnRenamed("prediction", "sentiment")
    return daily.daily_modal_sentiment(scored)


@query
def daily_text_concat(spark, d):
    return daily.daily_text(storage.written(_processed(spark, d), "processed"))


@query
def aggregate_daily(spark, d):
    rows = daily.aggregate_daily(_articles(spark, d))
    return rounded(
        rows.select(
            "date", "ticker", "sentiment", "n_articles", "text_length", F.posexplode("embedding").alias("pos", "x")
        )
    )


@query
def aggregate_daily_merged(spark, d):
    """The same days from two landings, each stored as partial days."""
    articles = storage.written(_articles(spark, d).join(t.news(spark, d).select("news_id", "source"), "news_id"), "articles")
    landings = [
        storage.written(daily.partial_days(articles.filter(F.col("source") == source)), "partial-days")
        for source in news_source.SOURCES
    ]
    rows = daily.finish_days(daily.merge_days(*landings))
    return rounded(
        rows.select(
            "date", "ticker", "sentiment", "n_articles", "text_length", F.posexplode("embedding").alias("pos", "x")
        )
    )


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    days = daily.aggregate_daily(_articles(spark, d))
    rows = storage.written(
        sequences.feature_rows(days, t.stock_prices(spark, d)), "feature-rows"
    )
    return sequences.sequence_windows(rows)


@query
def sequence_windows(spark, d):
    steps = _sequences(spark, d).select(
        "ticker", "start_date", "target", F.posexplode("seq").alias("step", "row")
    )
    return rounded(
        steps.select(
            "ticker", "start_date", "target", "step", F.posexplode("row").alias("pos", "x")
        )
    )


@query
def forecast_ensemble_mse(spark, d):
    """Errors of the fitted members' mean and of the last close on held-out windows, in prices.

    Fitted, so there is no SQL form; tests hold it against the last close.
    """
    days = daily.aggregate_daily(_articles(spark, d))
    rows = storage.written(sequences.feature_rows(days, t.stock_prices(spark, d)), "feature-rows")
    blocks = storage.written(sequences.sequence_blocks(rows), "sequence-blocks")
    width = t.EMBEDDING_DIM + len(sequences.PRICE_COLUMNS)
    model = forecast.fit_members(blocks, width, chosen=lambda *key: ~split.in_test(key))
    said = storage.written(forecast.predict_mean(blocks, model, lambda *key: split.in_test(key)), "forecasts")
    last = evaluate.mean_squared_error(said, prediction="last_close").withColumnRenamed("mse", "last_close_mse")
    return evaluate.mean_squared_error(said).join(last, "n")


@query
def forecast_fixed_members(spark, d):
    """Members without a fit: last close, mean and first close of the window."""
    closes = F.transform("seq", lambda row: F.element_at(row, -2))
    rows = _sequences(spark, d).select(
        "ticker",
        "start_date",
        "target",
        F.element_at(closes, -1).alias("last"),
        (F.aggregate(closes, F.lit(0.0), lambda a, x: a + x) / F.size(closes)).alias("mean"),
        F.element_at(closes, 1).alias("first"),
    )
    said = storage.written(forecast.mean_prediction(rows, ["last", "mean", "first"]), "fixed-members")
    plain = evaluate.mean_squared_error(said).withColumnRenamed("mse", "plain_mse")
    batches = evaluate.batch_mean_squared_error(said, ["ticker", "start_date"])
    return rounded(plain.join(batches, "n"), 4)


# Back-test.


@query
def first_signal_per_day(spark, d):
    return _signals(spark, d)


@query
def common_dates(spark, d):
    return backtest.common_dates(t.news(spark, d), t.stock_prices(spark, d))


@query
def holding_value(spark, d):
    return rounded(backtest.holding_value(t.stock_prices(spark, d, "user_id")))


@query
def return_sharpe(spark, d):
    value = backtest.holding_value(t.stock_prices(spark, d, "user_id"))
    return rounded(backtest.backtest_metrics(storage.written(value, "value")))


@query
def landed_training_frame(spark, d):
    """Payload files to landed, re-read news to labelled rows with features; numeric tickers."""
    ticker = F.format_string("%04d", F.col("news_id") % 150)
    rows = t.news(spark, d).withColumn("ticker", ticker)
    page = ["ticker", F.floor(F.col("news_id") / 1000).alias("_page")]
    item = F.struct(
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T08:30:00Z")).alias("publishedAt"),
        "title",
        "description",
        F.concat(F.lit("id "), F.col("news_id")).alias("content"),
    )
    payloads, landing = storage.new_path(spark, "payloads"), storage.new_path(spark, "landing")
    rows.groupBy(*page).agg(F.collect_list(item).alias("articles")).select("ticker", "articles").write.json(payloads)
    landed = news_source.land_payloads(spark, payloads, None, landing, *RANGE)
    bars = t.stock_prices(spark, d, "user_id").withColumn("ticker", F.lpad("ticker", 4, "0"))
    labels = prices.sentiment_labels(bars, t.index_prices(spark, d))
    frame = align.training_frame(news_text.clean_news(landed), labels, bars)
    content = landed.select("news_id", "content")
    return rounded(
        frame.join(content, "news_id").select(
            "date", "ticker", "cleaned_text", "sentiment", "text_length", "previous_close", "content"
        )
    )


@query
def backtest_files(spark, d):
    """Return and Sharpe ratio per ticker, written as JSON by ticker and read back."""
    path = storage.new_path(spark, "backtest")
    value = storage.written(backtest.holding_value(t.stock_prices(spark, d, "user_id")), "value")
    sinks.write_backtest_metrics(backtest.backtest_metrics(value), path)
    return rounded(sinks.read_backtest_metrics(spark, path))


# Charts.


@query
def chart_series(spark, d):
    return rounded(
        charts.chart_series(t.stock_prices(spark, d, "user_id"), t.index_prices(spark, d))
    )


@query
def chart_markers(spark, d):
    stock = t.stock_prices(spark, d, "user_id")
    labels = prices.sentiment_labels(stock, t.index_prices(spark, d))
    return rounded(charts.chart_markers(labels, stock))
