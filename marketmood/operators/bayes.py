"""Multinomial Naive Bayes as tables, on counts or on TF-IDF weights.

A fitted model is one table: a row per word with one log weight per label. The
class prior is the weight of the empty word ``""``, which every text carries
once; a text without known words is then scored by its prior, with no outer join
and no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS, best_label, softmax
from marketmood.functions.text import counted, vector_words
from marketmood.storage import fits, in_pieces, written

PRIOR = ""


def _weight(label: str) -> str:
    return f"w_{label}"


def _with_prior(words: Column) -> Column:
    return F.array_append(words, F.lit(PRIOR))


def bow_counts(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, token, n): word counts of each text, vocabulary words only."""
    words = docs.select(doc_id, F.inline(counted(vector_words(F.col(text)))))
    return in_pieces(words, vocabulary.select("token"), "token", "left_semi").select(doc_id, "token", "n")


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """The distinct words of a corpus."""
    return docs.select(F.explode(vector_words(F.col(text))).alias("token")).distinct()


def _label_counts(tokens: DataFrame, amount: Column | None = None) -> DataFrame:
    """Sum per word and label, one row per word, merged before the shuffle."""
    def total(label: str) -> Column:
        hit = F.col("label") == label
        return F.count_if(hit) if amount is None else F.sum(F.when(hit, amount).otherwise(0.0))

    return tokens.groupBy("token").agg(*[total(l).alias(l) for l in LABELS])


def _log_weights(counts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Laplace-smoothed log likelihoods; unsmoothed log prior on the empty word.

    ``counts`` is written, so the one row of totals costs one small pass.
    """
    is_prior = F.col("token") == PRIOR
    totals = counts.agg(
        *[F.sum(F.when(~is_prior, F.col(l) + 1)).alias(l) for l in LABELS],
        F.sum(F.when(is_prior, sum((F.col(l) for l in LABELS), F.lit(0)))).alias("docs"),
    ).first()

    def weight(label: str) -> Column:
        prior = F.when(F.col(label) > 0, F.ln(F.col(label)) - F.ln(F.lit(float(totals["docs"]))))
        like = F.ln(F.col(label) + 1) - F.ln(F.lit(float(totals[label] or 1)))
        return F.when(is_prior, prior).otherwise(like).alias(_weight(label))

    return counts.select("token", *keep, *[weight(l) for l in LABELS])


def count_words(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(token, bullish, neutral, bearish) of (text, label) rows: how often a word has a label.

    The empty word counts the texts. With ``known`` (token, written) words outside it are
    dropped, before the shuffle if it can be broadcast and else from the counts. Counts of two corpora add up to those of both, so they
    are what a fitted model keeps; weights follow from them.
    """
    words = docs.select("label", F.explode(_with_prior(vector_words(F.col("text")))).alias("token"))
    if known is None:
        return _label_counts(words)
    kept = known.select("token")
    if fits(kept):
        return _label_counts(words.join(F.broadcast(kept), "token", "left_semi"))
    return _label_counts(words).join(kept, "token", "left_semi")


def continue_counts(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``counts`` (written) with a further corpus added; the vocabulary stays that of ``counts``."""
    more = count_words(docs, counts).withColumnsRenamed({l: f"more_{l}" for l in LABELS})
    return counts.join(more, "token", "left").select(
        "token", *[(F.col(l) + F.coalesce(f"more_{l}", F.lit(0))).alias(l) for l in LABELS]
    )


def log_weights(counts: DataFrame) -> DataFrame:
    """(token, w_bullish, w_neutral, w_bearish) of written counts."""
    return _log_weights(counts)


def fit(specific: DataFrame, general: DataFrame | None = None) -> DataFrame:
    """Fit on (text, label) rows; returns (token, w_bullish, w_neutral, w_bearish).

    The vocabulary is that of the general corpus if there is one; its counts and
    those of the specific corpus add up.
    """
    return log_weights(fit_counts(specific, general))


def fit_counts(specific: DataFrame, general: DataFrame | None = None) -> DataFrame:
    """The written counts that ``fit`` weighs."""
    if general is None:
        return written(count_words(specific), "nb-counts")
    base = written(count_words(general), "nb-general")
    return written(continue_counts(base, specific), "nb-counts")


def joint_scores(docs: DataFrame, weights: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns plus one log score per label.

    ``keep`` must identify a row. Words meet their weights by broadcast, of a large model
    those of its frequent words (``in_pieces``); sums are combined per text before the
    shuffle, so what moves is one narrow row per text and part, and of a model beyond some
    broadcasts the rare words. ``weights`` are written.
    """
    words = docs.select(*keep, F.explode(_with_prior(vector_words(F.col(text)))).alias("token"))
    return (
        in_pieces(words, weights, "token", often=_frequency(weights))
        .groupBy(*keep)
        .agg(*[F.sum(_weight(l)).alias(l) for l in LABELS], *_absent(weights))
        .select(*keep, *[_drop_absent(l) for l in LABELS])
    )


def _frequency(weights: DataFrame) -> Column:
    """Higher for more frequent words: within a label a weight grows with the count."""
    return F.greatest(*[F.col(_weight(l)) for l in LABELS])


def _absent(weights: DataFrame) -> list[Column]:
    """Per label the prior alone: NULL marks a label never seen in training."""
    prior = F.col("token") == PRIOR
    return [F.max(F.when(prior, F.col(_weight(l)))).alias(f"_prior_{l}") for l in LABELS]


def _drop_absent(label: str) -> Column:
    return F.when(F.col(f"_prior_{label}").isNotNull(), F.col(label)).alias(label)


def predict(scores: DataFrame, decimals: int = 9) -> DataFrame:
    """Add ``prediction``: best score, ties to the alphabetically first label.

    Scores are compared after rounding, so the order in which a sum was taken
    cannot decide a tie.
    """
    return scores.withColumn(
        "prediction", best_label({l: F.round(l, decimals) for l in sorted(LABELS)})
    )


def predict_proba(scores: DataFrame) -> DataFrame:
    """Log scores turned into probabilities under the same column names."""
    shares = softmax([F.col(l) for l in LABELS])
    return scores.withColumns(dict(zip(LABELS, shares)))


def inverse_document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(token, df, idf) with idf = ln((1 + n) / (1 + df)) + 1.

    The empty word every text carries counts the texts in the same pass.
    """
    words = F.array_distinct(_with_prior(vector_words(F.col(text))))
    counts = written(
        docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df"
    )
    n = counts.filter(F.col("token") == PRIOR).first()
    idf = F.ln(F.lit(1.0 + (n["df"] if n else 0)) / (1 + F.col("df"))) + 1
    return counts.filter(F.col("token") != PRIOR).withColumn("idf", idf)


def tfidf(docs: DataFrame, idf: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` plus (token, tfidf), each text scaled to length 1.

    Counting happens inside the row; a text's words meet again as one array, which is
    scaled and unfolded, so nothing is sorted. ``keep`` must identify a row.
    """
    words = docs.select(*keep, F.inline(counted(vector_words(F.col(text)))))
    weighted = in_pieces(words, idf.select("token", "idf"), "token", often=-F.col("idf")).select(
        *keep, F.struct("token", (F.col("n") * F.col("idf")).alias("raw")).alias("_word")
    )
    squares = F.col("_word.raw") * F.col("_word.raw")
    texts = weighted.groupBy(*keep).agg(F.collect_list("_word").alias("_words"), F.sqrt(F.sum(squares)).alias("_norm"))
    return texts.select(*keep, F.col("_norm"), F.inline("_words")).select(
        *keep, "token", (F.col("raw") / F.col("_norm")).alias("tfidf")
    )


def fit_tfidf(train: DataFrame) -> DataFrame:
    """Fit on (doc_id, text, label) rows; the model table also holds ``idf``."""
    idf = written(inverse_document_frequency(train, "text"), "tfidf-idf")
    words = tfidf(train, idf, ["doc_id", "label"], "text")
    sums = _label_counts(words, F.col("tfidf")).join(idf.select("token", "idf"), "token")
    prior = _label_counts(train.select("label", F.lit(PRIOR).alias("token"))).select(
        "token", *[F.col(l).cast("double").alias(l) for l in LABELS], F.lit(0.0).alias("idf")
    )
    counts = written(sums.unionByName(prior), "tfidf-counts")
    return _log_weights(counts, keep=("idf",))


def joint_scores_tfidf(
    docs: DataFrame, weights: DataFrame, keep: list[str], text: str
) -> DataFrame:
    """Log scores under TF-IDF weights.

    The norm divides the whole sum, so sum and norm come from one aggregation per
    text and no word row is shuffled.
    """
    prior = F.col("token") == PRIOR
    raw = F.when(~prior, F.col("n") * F.col("idf"))
    words = in_pieces(
        docs.select(*keep, F.inline(counted(_with_prior(vector_words(F.col(text)))))), weights, "token", often=-F.col("idf")
    )
    sums = words.groupBy(*keep).agg(
        F.sqrt(F.sum(raw * raw)).alias("_norm"),
        *[F.sum(raw * F.col(_weight(l))).alias(l) for l in LABELS],
        *_absent(weights),
    )
    return sums.select(
        *keep,
        *[
            (F.col(f"_prior_{l}") + F.coalesce(F.col(l) / F.col("_norm"), F.lit(0.0))).alias(l)
            for l in LABELS
        ],
    )
