"""Blend of a learned classifier and the lexicon, and its tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS, best_label, polarity_shares

# Fixed grid: thresholds 0, 0.05 .. 0.30 by weights 0.5, 0.6 .. 0.9, threshold
# first; and the defaults.
N_THRESHOLDS, THRESHOLD_STEP = 7, 0.05
N_WEIGHTS, WEIGHT_START, WEIGHT_STEP = 5, 0.5, 0.1
DEFAULT_THRESHOLD = 0.05
DEFAULT_WEIGHT = 0.7


def blend_shares(
    compound: Column, threshold: float | Column, weight: float | Column
) -> dict[str, Column]:
    """weight * learned + (1 - weight) * lexicon, learned in the label columns."""
    lexicon = polarity_shares(compound, threshold, -threshold)
    return {l: F.lit(weight) * F.col(l) + F.lit(1 - weight) * lexicon[l] for l in LABELS}


def blend_predict(
    members: DataFrame, threshold: float = DEFAULT_THRESHOLD, weight: float = DEFAULT_WEIGHT
) -> DataFrame:
    """Members hold the learned probabilities and ``compound``; both are blended."""
    shares = blend_shares(F.col("compound"), threshold, weight)
    return members.withColumns({**shares, "prediction": best_label(shares)})


def _right(shares: dict[str, Column], label: Column) -> Column:
    """Whether the blend's first best label is ``label``, by plain comparisons."""
    tests = None
    for i, own in enumerate(LABELS):
        before = [shares[own] > shares[other] for other in LABELS[:i]]
        after = [shares[own] >= shares[other] for other in LABELS[i + 1 :]]
        best = reduce(Column.__and__, [*before, *after])
        tests = F.when(label == own, best) if tests is None else tests.when(label == own, best)
    return tests.otherwise(False)


def blend_grid(members: DataFrame, label: str = "label") -> DataFrame:
    """(pos_thresh, weight, accuracy) of all 35 settings in one pass over the data.

    Every setting is one counter of the same aggregate: rows are not unfolded, a task
    sends one row, and the 35 counts are laid out as rows at the end.
    """
    settings = []
    for i in range(N_THRESHOLDS * N_WEIGHTS):
        settings.append((i // N_WEIGHTS * THRESHOLD_STEP, WEIGHT_START + i % N_WEIGHTS * WEIGHT_STEP))
    right = [_right(blend_shares(F.col("compound"), F.lit(t), F.lit(w)), F.col(label)) for t, w in settings]
    counts = members.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"right_{i}") for i, r in enumerate(right)])
    rows = [
        F.struct(F.lit(t).alias("pos_thresh"), F.lit(w).alias("weight"), (F.col(f"right_{i}") / F.col("n")).alias("accuracy"))
        for i, (t, w) in enumerate(settings)
    ]
    return counts.filter("n > 0").select(F.inline(F.array(*rows)))


def blend_best(grid: DataFrame) -> DataFrame:
    """The first setting of highest accuracy; the defaults if none is above 0."""
    fallback = grid.sparkSession.range(1).select(
        F.lit(DEFAULT_THRESHOLD).alias("pos_thresh"),
        F.lit(DEFAULT_WEIGHT).alias("weight"),
        F.lit(0.0).alias("accuracy"),
        F.lit(1).alias("_late"),
    )
    return (
        grid.filter("accuracy > 0")
        .withColumn("_late", F.lit(0))
        .unionByName(fallback)
        .orderBy(F.col("accuracy").desc(), "_late", "pos_thresh", "weight")
        .limit(1)
        .drop("_late")
    )
