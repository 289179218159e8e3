"""Accuracy, weighted precision / recall / F1, confusion matrix, squared error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS


def eval_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, accuracy and support-weighted precision, recall and F1.

    One pass of counters; zero denominators give 0.
    """
    y, yhat = F.col(label), F.col(prediction)
    counts = predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == yhat).alias("hits"),
        *[F.count_if(y == l).alias(f"true_{l}") for l in LABELS],
        *[F.count_if(yhat == l).alias(f"said_{l}") for l in LABELS],
        *[F.count_if((y == l) & (yhat == l)).alias(f"both_{l}") for l in LABELS],
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    def weighted(value) -> Column:
        parts = [F.col(f"true_{l}") * value(l) for l in LABELS]
        return ratio(sum(parts[1:], parts[0]), F.col("n"))

    def precision(l: str) -> Column:
        return ratio(F.col(f"both_{l}"), F.col(f"said_{l}"))

    def recall(l: str) -> Column:
        return ratio(F.col(f"both_{l}"), F.col(f"true_{l}"))

    def f1(l: str) -> Column:
        return ratio(2 * F.col(f"both_{l}"), F.col(f"true_{l}") + F.col(f"said_{l}"))

    return counts.select(
        "n",
        ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Three rows (true label) by three columns (predicted), zero-filled."""
    cells = predictions.agg(
        *[
            F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"{t}_{p}")
            for t in LABELS
            for p in LABELS
        ]
    )
    rows = [
        F.struct(F.lit(t).alias("label"), *[F.col(f"{t}_{p}").alias(p) for p in LABELS])
        for t in LABELS
    ]
    return cells.select(F.inline(F.array(*rows)))


def sentiment_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


def mean_squared_error(predictions: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    gap = F.col(target) - F.col(prediction)
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("mse"))


def batch_mean_squared_error(
    predictions: DataFrame,
    order: list[str],
    batch: int = 32,
    target: str = "target",
    prediction: str = "prediction",
) -> DataFrame:
    """One row (n, mse): mean of the errors of successive batches.

    All batches but the last are full, so only the rows of a short last batch
    weigh differently; they are the final ``n % batch`` rows of the order, fewer
    than one batch, found by a bounded top-k.
    """
    gap = F.col(target) - F.col(prediction)
    errors = predictions.select(*order, (gap * gap).alias("_error"))
    n = errors.count()
    full, rest = divmod(n, batch)
    parts = errors.agg(F.sum("_error").alias("_sum"), F.lit(0.0).alias("_tail"))
    if rest:
        tail = errors.orderBy(*[F.col(c).desc() for c in order]).limit(rest)
        parts = parts.unionByName(
            tail.agg(F.lit(0.0).alias("_sum"), F.sum("_error").alias("_tail"))
        )
    sums = parts.agg(F.sum("_sum").alias("_sum"), F.sum("_tail").alias("_tail"))
    short = F.col("_tail") / rest if rest else F.lit(0.0)
    batches = full + (1 if rest else 0)
    mse = ((F.col("_sum") - F.col("_tail")) / batch + short) / max(batches, 1)
    return sums.select(F.lit(n).cast("long").alias("n"), mse.alias("mse"))
