"""Labels, recodings, scores and probabilities as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label order of matrices and probability columns, and the
# codes used by the labelled phrase corpus and the classifiers.
BULLISH, NEUTRAL, BEARISH = "bullish", "neutral", "bearish"
LABELS = (BULLISH, NEUTRAL, BEARISH)
PHRASE_CODES = {0: BEARISH, 1: BULLISH, 2: NEUTRAL}
SENTIMENT_WORDS = {"positive": BULLISH, "neutral": NEUTRAL, "negative": BEARISH}
LABEL_INDEX = {BULLISH: 0, NEUTRAL: 1, BEARISH: 2}
BAND = 0.5


def recode(value: Column, mapping: Mapping) -> Column:
    """Look ``value`` up in a small fixed mapping; unknown gives NULL."""
    chain = None
    for key, to in mapping.items():
        step = (F.when if chain is None else chain.when)(value == F.lit(key), F.lit(to))
        chain = step
    return chain


def band_label(stock: Column, index: Column, band: float = BAND) -> Column:
    """Stock against index return, both in percent; strict on both sides."""
    return (
        F.when(stock > index + band, BULLISH)
        .when(stock < index - band, BEARISH)
        .otherwise(NEUTRAL)
    )


def polarity_label(score: Column, pos: float | Column = 0.05, neg: float | Column = -0.05) -> Column:
    return F.when(score > pos, BULLISH).when(score < neg, BEARISH).otherwise(NEUTRAL)


def polarity_shares(
    score: Column, pos: float | Column = 0.05, neg: float | Column = -0.05
) -> dict[str, Column]:
    """Three pseudo-probabilities from one polarity score."""
    width = pos - neg + 1
    bull = F.when(
        score > 0, F.greatest((score - F.lit(neg)) / F.lit(width), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    bear = F.when(
        score < 0, F.greatest((F.lit(pos) - score) / F.lit(width), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    return {BULLISH: bull, NEUTRAL: F.lit(1.0) - bull - bear, BEARISH: bear}


def best_label(scores: Mapping[str, Column]) -> Column:
    """Label of the highest score; the first in ``scores`` wins a tie."""
    ranked = [
        F.struct(
            score.alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label")
        )
        for i, (label, score) in enumerate(scores.items())
    ]
    return F.array_max(F.array(*ranked))["label"]


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Stable softmax; a NULL score (a class never seen) gets probability 0."""
    top = F.greatest(*scores)
    powers = [F.coalesce(F.exp(s - top), F.lit(0.0)) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]
