"""Polarity of a text from a word table, with degree words and negation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.labels import polarity_label, polarity_shares
from marketmood.functions.text import spaced_words
from marketmood.functions.words import (
    DAMPENERS,
    DEGREE,
    INTENSIFIERS,
    NEGATION,
    NEGATORS,
    SEED_VALENCES,
)
from marketmood.storage import in_pieces, small, written

ALPHA = 15.0
# Influence of the first, second and third word before.
DAMPING = (1.0, 0.95, 0.9)
_END = ""


def seed_lexicon(spark: SparkSession) -> DataFrame:
    """(token, valence): the small table shipped for tests."""
    return spark.createDataFrame(list(SEED_VALENCES.items()), "token string, valence double")


def modifiers(spark: SparkSession) -> DataFrame:
    """(token, degree, negates): the published degree and negation words."""
    rows = (
        [(w, DEGREE, False) for w in INTENSIFIERS]
        + [(w, -DEGREE, False) for w in DAMPENERS]
        + [(w, 0.0, True) for w in NEGATORS]
    )
    return spark.createDataFrame(rows, "token string, degree double, negates boolean")


def _in_context(words: Column) -> Column:
    """Each word beside the three before it, and one empty word closing the text.

    The word array is zipped with itself shifted by one, two and three places;
    the surplus places at the end have no word and meet nothing in the join.
    """
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array_repeat(none, k), words) for k in (1, 2, 3)]
    return F.arrays_zip(
        F.array_append(words, F.lit(_END)).alias("token"),
        *[s.alias(f"before_{k}") for k, s in zip((1, 2, 3), shifted)],
    )


def polarity(
    docs: DataFrame,
    lexicon: DataFrame,
    keep: list[str],
    text: str = "cleaned_text",
    modifier_words: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns plus ``compound`` in [-1, 1]; ``keep`` must identify a row.

    A word's context travels in its own row, so neither a window nor a shuffle of
    words is needed: words without valence are dropped at the join, and sums are
    combined per text before the shuffle. The empty closing word has no valence
    and only keeps texts without any known word.
    """
    spark = docs.sparkSession
    changes = modifiers(spark) if modifier_words is None else modifier_words
    # A degree word scores nothing itself; a word with valence changes nothing.
    scored = lexicon.select("token", "valence").join(
        small(changes.filter("degree <> 0").select("token")), "token", "left_anti"
    ).unionByName(
        spark.range(1).select(
            F.lit(_END).alias("token"), F.lit(None).cast("double").alias("valence")
        )
    )
    active = small(
        changes.join(lexicon.select("token"), "token", "left_anti").select(
            F.col("token").alias("_token"), "degree", "negates"
        )
    )
    words = F.filter(spaced_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.length(w) > 1)
    listed = docs.select(*keep, words.alias("_words"))
    context = F.inline(_in_context(F.col("_words"))).alias(
        "token", "before_1", "before_2", "before_3"
    )
    hits = in_pieces(listed.select(*keep, context), written(scored, "valences"), "token")
    for k in (1, 2, 3):
        renamed = active.withColumnsRenamed(
            {"_token": f"before_{k}", "degree": f"degree_{k}", "negates": f"negates_{k}"}
        )
        hits = hits.join(renamed, f"before_{k}", "left")
    value = F.col("valence")
    for k, damping in zip((1, 2, 3), DAMPING):
        degree = F.coalesce(f"degree_{k}", F.lit(0.0)) * damping
        hits = hits.withColumn("_value", value)
        value = F.col("_value") + F.when(F.col("_value") < 0, -degree).otherwise(degree)
        value = value * F.when(F.coalesce(f"negates_{k}", F.lit(False)), NEGATION).otherwise(1.0)
    total = F.col("_total")
    compound = F.round(total / F.sqrt(total * total + ALPHA), 4)
    return (
        hits.groupBy(*keep)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_total"))
        .select(*keep, F.least(F.greatest(compound, F.lit(-1.0)), F.lit(1.0)).alias("compound"))
    )


def predict(scored: DataFrame, pos: float = 0.05, neg: float = -0.05) -> DataFrame:
    return scored.withColumn("prediction", polarity_label(F.col("compound"), pos, neg))


def predict_proba(scored: DataFrame, pos: float = 0.05, neg: float = -0.05) -> DataFrame:
    return scored.withColumns(polarity_shares(F.col("compound"), pos, neg))
