"""Multinomial regression in stages: each is pulled towards the weights of the one before.

The first stage is fitted on a general corpus. A further stage starts from its weights and
pays for moving away from them, so few specific rows bend a model and do not replace it.
A text's features are its hashed words, damped and scaled to length 1, so no pass over a
corpus is needed before fitting. Loss and gradient are summed per task over Arrow batches
and over tasks as in ``moments``; the weights, of a size fixed by ``features``, stay with
the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.functions.labels import LABEL_INDEX, LABELS, best_label, recode
from marketmood.functions.text import counted, vector_words
from marketmood.operators.moments import summed
from marketmood.storage import written

# Weight of the squared distance from the stage before, per row; from zero in the first.
PULL, FIRST_PULL = 1e-3, 1e-3
# Features a worker takes at once.
BLOCK = 1 << 17
_HISTORY, _HALVINGS, _DECREASE, _CONVERGED = 8, 12, 1e-4, 1e-7


@dataclass
class Regression:
    """Weights per feature and label; the last row is the intercept."""

    weights: np.ndarray

    @property
    def features(self) -> int:
        return len(self.weights) - 1


def _features(text: Column, features: int) -> Column:
    """array<struct<at, x>>: places of the hashed words, ascending, and 1 + ln(count)."""
    places = F.transform(vector_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(features)))
    return F.transform(counted(places), lambda word: F.struct(word["token"].cast("int").alias("at"), (1 + F.ln(word["n"])).alias("x")))


def _packed(rows: DataFrame) -> DataFrame:
    """(label, at, x): a text's places and values as bytes, which Spark moves without looking inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, np.diff(batch.column("words").offsets.to_numpy())):
                words = block.column("words")
                ends = words.offsets.to_numpy() - words.offsets[0].as_py()
                at, x = (c.to_numpy() for c in words.flatten().flatten())
                yield pa.RecordBatch.from_arrays([block.column("label"), _bytes(ends, at.astype("<i4")), _bytes(ends, x.astype("<f8"))], ["label", "at", "x"])

    return rows.select("label", "words").mapInArrow(run, "label int, at binary, x binary")


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Each row's values as one binary value."""
    offsets = (ends * values.itemsize).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number per row) of such a column."""
    width = np.dtype(dtype).itemsize
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    return whole[ends[0] : ends[-1]].view(dtype), np.diff(ends) // width


def _blocks(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch in slices of whole rows of BLOCK features at most, or of one longer row: what a
    worker holds beside its batch does not grow with it."""
    ends, at = np.r_[0, np.cumsum(sizes)], 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _matrix(sizes: np.ndarray, at: np.ndarray, x: np.ndarray, intercept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the features of texts, each row of length 1, with the intercept."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    norm = np.sqrt(np.bincount(row, x * x, len(sizes)))
    every = np.arange(len(sizes))
    return np.r_[row, every], np.r_[at, np.full(len(sizes), intercept)], np.r_[x / norm[row], np.ones(len(sizes))]


def _logits(row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(row, x * weights[at, c], n) for c in range(weights.shape[1])])


def _shares(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _objective(rows: DataFrame, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(rows, summed log loss, its gradient) at these weights: one pass over (label, words) rows,
    or over what ``_packed`` makes of them."""
    shape = weights.shape

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for block in _blocks(batch, _values(batch.column("at"), "<i4")[1]):
            add_block(block, sums)

    def add_block(block: pa.RecordBatch, sums: np.ndarray) -> None:
        labels = block.column("label").to_numpy()
        places, sizes = _values(block.column("at"), "<i4")
        row, at, x = _matrix(sizes, places, _values(block.column("x"), "<f8")[0], shape[0] - 1)
        shares = _shares(_logits(row, at, x, len(labels), weights))
        own = np.arange(len(labels))
        sums[0] += len(labels)
        sums[1] -= np.log(np.maximum(shares[own, labels], 1e-300)).sum()
        shares[own, labels] -= 1
        gradient = sums[2:].reshape(shape)
        for c in range(shape[1]):
            gradient[:, c] += np.bincount(at, x * shares[row, c], shape[0])

    total = summed(rows if "at" in rows.columns else _packed(rows), add, 2 + weights.size)
    return total[0], total[1], total[2:].reshape(shape)


def _direction(gradient: np.ndarray, history: deque) -> np.ndarray:
    """The quasi-Newton step of limited memory: the gradient seen through the last steps."""
    step, taken = gradient.copy(), []
    for s, y in reversed(history):
        a = np.vdot(s, step) / np.vdot(s, y)
        step -= a * y
        taken.append((a, s, y))
    if history:
        s, y = history[-1]
        step *= np.vdot(s, y) / np.vdot(y, y)
    for a, s, y in reversed(taken):
        step += s * (a - np.vdot(y, step) / np.vdot(s, y))
    return -step


def _minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int) -> np.ndarray:
    at = start
    loss, gradient = value(at)
    history: deque = deque(maxlen=_HISTORY)
    for _ in range(rounds):
        step = _direction(gradient, history)
        slope, length = float(np.vdot(gradient, step)), 1.0
        for _ in range(_HALVINGS):
            new = at + length * step
            new_loss, new_gradient = value(new)
            if new_loss <= loss + _DECREASE * length * slope:
                break
            length /= 2
        else:
            return at
        gained, moved, turned = loss - new_loss, new - at, new_gradient - gradient
        at, loss, gradient = new, new_loss, new_gradient
        if np.vdot(moved, turned) > 0:
            history.append((moved, turned))
        if gained < _CONVERGED * max(1.0, abs(loss)):
            break
    return at


def fit(
    rows: DataFrame,
    before: Regression | None = None,
    features: int = 1 << 16,
    max_iter: int = 20,
    pull: float | None = None,
) -> Regression:
    """Fit on (text, label) rows, pulled towards ``before`` if given, else towards zero.

    A null text has no words; rows with another label than the library's, or none, are
    left out. Without rows the result is ``before``. Every step of the descent is one
    pass over the rows' features, which are written once.
    """
    label = recode(F.col("label"), LABEL_INDEX)
    ready = rows.select(label.cast("int").alias("label"), _features(F.col("text"), features).alias("words")).filter("label is not null")
    ready = written(_packed(ready), "staged-features")
    centre = before.weights if before is not None else np.zeros((features + 1, len(LABELS)))
    if len(centre) != features + 1:
        raise ValueError(f"the stage before has {len(centre) - 1} features, not {features}")
    strength = pull if pull is not None else PULL if before is not None else FIRST_PULL

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, gradient = _objective(ready, weights)
        away = weights - centre
        away[-1] = 0  # intercepts move freely
        return loss / max(n, 1) + strength / 2 * np.vdot(away, away), gradient / max(n, 1) + strength * away

    return Regression(_minimise(value, centre, max_iter))


def predict(docs: DataFrame, model: Regression, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, one probability per label and ``prediction``; no shuffle."""
    weights = model.weights
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(l, T.DoubleType()) for l in LABELS)])
    ready = docs.select(*keep, _features(F.col(text), model.features).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, np.diff(batch.column("words").offsets.to_numpy())):
                words = block.column("words")
                at, x = (c.to_numpy() for c in words.flatten().flatten())
                matrix = _matrix(np.diff(words.offsets.to_numpy()), at, x, len(weights) - 1)
                shares = _shares(_logits(*matrix, block.num_rows, weights))
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *(pa.array(shares[:, i]) for i in range(len(LABELS)))], [*keep, *LABELS])

    return ready.mapInArrow(run, schema).withColumn("prediction", best_label({l: F.col(l) for l in LABELS}))


def log_likelihood(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row (n, log_likelihood): the mean log probability of the true labels."""
    own = F.coalesce(*[F.when(F.col(label) == l, F.col(l)) for l in LABELS])
    return predictions.agg(F.count(own).alias("n"), F.avg(F.ln(F.greatest(own, F.lit(1e-300)))).alias("log_likelihood"))


def as_table(spark: SparkSession, model: Regression) -> DataFrame:
    """(features, at, weights): the weights that are not zero, a row per feature."""
    used = np.flatnonzero(model.weights.any(axis=1))
    rows = [(model.features, int(i), [float(x) for x in model.weights[i]]) for i in used] or [(model.features, 0, [0.0] * len(LABELS))]
    return spark.createDataFrame(rows, "features int, at int, weights array<double>")


def from_table(table: DataFrame) -> Regression:
    rows = table.collect()
    weights = np.zeros((rows[0]["features"] + 1, len(LABELS)))
    for row in rows:
        weights[row["at"]] = row["weights"]
    return Regression(weights)
