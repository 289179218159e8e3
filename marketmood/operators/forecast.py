"""Next-close forecast from sequences: ridge regressions on random features, averaged.

A window is described without a look at other windows: prices against the mean close of
the window, volume against its mean, the mean vector, and cosines of random directions of
these. Members see different numbers of directions. One pass over the blocks of days sums
the Gram matrix and the moments of all of them; per member one eigen decomposition then
serves every strength of the penalty, and the strength is the one of the least
generalised cross-validation error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.operators.moments import summed
from marketmood.operators.sequences import _BLOCK, PRICE_COLUMNS, SEQ_LENGTH

# Random directions of each member, and the penalties each may choose from, strongest first.
WIDTHS = (32, 64, 128)
STRENGTHS = tuple(10.0**i for i in range(4, -6, -1))
_SEED, _REACH = 5, 5.0


@dataclass
class Member:
    """A ridge regression on the first ``len(weights)`` features."""

    weights: np.ndarray
    intercept: float
    strength: float


@dataclass
class Forecast:
    length: int
    dim: int
    members: list[Member]


def _scale(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean close of each window and the unit its prices are measured in."""
    mean = windows[:, :, -2].mean(axis=1)
    unit = np.abs(windows[:, :, -2]).mean(axis=1)
    return mean, np.where(unit > 0, unit, 1.0)


def described(windows: np.ndarray, directions: int) -> np.ndarray:
    """Features of windows (n, days, dim): plain ones first, then the random directions."""
    mean, unit = _scale(windows)
    n, length, dim = windows.shape
    prices = (windows[:, :, -5:-1] - mean[:, None, None]) / unit[:, None, None]
    volume = windows[:, :, -1]
    usual = np.abs(volume).mean(axis=1, keepdims=True)
    plain = np.concatenate([prices.reshape(n, -1), volume / np.where(usual > 0, usual, 1.0) - 1, windows[:, :, :-5].mean(axis=1)], axis=1)
    plain = np.clip(plain, -_REACH, _REACH)
    draw = np.random.default_rng([_SEED, length, dim])
    angles = plain @ draw.normal(0, 1 / np.sqrt(plain.shape[1]), (plain.shape[1], directions)) + draw.uniform(0, 2 * np.pi, directions)
    return np.concatenate([plain, np.cos(angles)], axis=1)


def _windows(batch: pa.RecordBatch, length: int, dim: int) -> Iterator[tuple]:
    """(ticker, start dates, windows, targets, chosen) of each block of a batch."""
    for i, ticker in enumerate(batch.column("ticker").to_pylist()):
        days = batch.column("days").slice(i, 1).flatten()
        starts = min(_BLOCK, len(days) - length)
        if starts <= 0:
            continue
        _, dates, features, closes = days.flatten()
        rows = np.array([np.array(f, float) if f is not None else np.full(dim, np.nan) for f in features.to_pylist()])
        close = np.array([np.nan if c is None else c for c in closes.to_pylist()], float)
        windows = sliding_window_view(rows[: starts + length - 1], length, axis=0).transpose(0, 2, 1)
        dates = dates.slice(0, starts)
        chosen = np.array(batch.column("chosen")[i].as_py()[:starts], bool)
        yield ticker, dates, windows, close[length : length + starts], chosen


def _with_choice(blocks: DataFrame, chosen: Column | None) -> DataFrame:
    """``chosen`` is a condition on ``ticker`` and ``day``, which is the window's first."""
    flags = F.transform("days", lambda day: F.lit(True)) if chosen is None else F.transform("days", lambda day: chosen(F.col("ticker"), day["date"]))
    return blocks.select("ticker", "days", flags.alias("chosen"))


def gram(blocks: DataFrame, dim: int, length: int = SEQ_LENGTH, directions: int = max(WIDTHS), chosen=None) -> np.ndarray:
    """Sums of products of (1, features, target) over the chosen windows: one pass.

    Features and target are measured in the window's unit and weighed by its square, so
    errors count in prices. Windows with a missing value or target are left out.
    """
    width = 2 + length * len(PRICE_COLUMNS) + dim - len(PRICE_COLUMNS) + directions

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for _, _, windows, target, wanted in _windows(batch, length, dim):
            good = wanted & np.isfinite(target) & np.isfinite(windows).all(axis=(1, 2))
            if good.any():
                mean, unit = _scale(windows[good])
                rows = np.column_stack([np.ones(good.sum()), described(windows[good], directions), (target[good] - mean) / unit])
                rows *= unit[:, None]
                sums += np.r_[(rows.T @ rows).ravel(), good.sum()]

    return summed(_with_choice(blocks, chosen), add, width * width + 1)


def ridge(sums: np.ndarray, features: int, strengths: Sequence[float]) -> list[tuple[float, np.ndarray, float, float]]:
    """(strength, weights, intercept, error) of the first features for every strength.

    ``sums`` as from ``gram``. The intercept is free; a strength is relative to the
    features' variance. The error is that of generalised cross-validation.
    """
    n, size = sums[-1], int(np.sqrt(len(sums) - 1))
    whole = sums[:-1].reshape(size, size)
    weight = whole[0, 0]
    mean, target = whole[0, 1 : 1 + features] / weight, whole[0, -1] / weight
    spread = whole[1 : 1 + features, 1 : 1 + features] / weight - np.outer(mean, mean)
    shared = whole[1 : 1 + features, -1] / weight - mean * target
    total = whole[-1, -1] / weight - target**2
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(spread / np.outer(scale, scale))
    values = np.maximum(values, 0)
    along = vectors.T @ (shared / scale)
    out = []
    for strength in strengths:
        shrunk = along / (values + strength)
        weights = vectors @ shrunk / scale
        left = total - 2 * shrunk @ along + (shrunk**2) @ values
        freedom = 1 + (values / (values + strength)).sum()
        # A fit that spends half of the windows' freedom is not judged by its own windows.
        error = max(left, 0) / (1 - freedom / n) ** 2 if 2 * freedom < n else np.inf
        out.append((strength, weights, float(target - mean @ weights), float(error)))
    return out


def fit_members(
    blocks: DataFrame,
    dim: int,
    length: int = SEQ_LENGTH,
    widths: Sequence[int] = WIDTHS,
    strengths: Sequence[float] = STRENGTHS,
    chosen=None,
) -> Forecast:
    """Members of different widths from one pass over ``sequence_blocks``.

    ``dim`` is the size of a day's features. ``chosen(ticker, date)`` gives the condition
    for a window's first day; without it all windows are fitted. Without windows every
    member predicts the mean close of its window.
    """
    sums = gram(blocks, dim, length, max(widths), chosen)
    plain = int(np.sqrt(len(sums) - 1)) - 2 - max(widths)
    members = []
    for width in widths:
        if not sums[-1]:
            members.append(Member(np.zeros(plain + width), 0.0, strengths[0]))
            continue
        strength, weights, intercept, _ = min(ridge(sums, plain + width, strengths), key=lambda fit: fit[3])
        members.append(Member(weights, intercept, strength))
    return Forecast(length, dim, members)


def predict_mean(blocks: DataFrame, model: Forecast, chosen=None) -> DataFrame:
    """(ticker, start_date, last_close, target, member_0.., prediction) of the chosen windows.

    ``prediction`` is the mean of the members; windows with a missing value have none.
    """
    names = [f"member_{i}" for i in range(len(model.members))]
    plain_names = ["ticker", "start_date", "last_close", "target", *names, "prediction"]
    directions = max(len(m.weights) for m in model.members) - min(len(m.weights) for m in model.members)
    smallest = min(len(m.weights) for m in model.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ticker, dates, windows, target, wanted in _windows(batch, model.length, model.dim):
                plain = windows.shape[1] * len(PRICE_COLUMNS) + model.dim - len(PRICE_COLUMNS)
                features = described(windows, directions + smallest - plain)
                mean, unit = _scale(windows)
                said = [mean + unit * (features[:, : len(m.weights)] @ m.weights + m.intercept) for m in model.members]
                numbers = [windows[:, -1, -2], target, *said, np.mean(said, axis=0)]
                columns = [pa.array([ticker] * len(target)), dates, *(pa.array(x, mask=~np.isfinite(x)) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns, plain_names).filter(pa.array(wanted))

    schema = "ticker string, start_date date, " + ", ".join(f"{n} double" for n in plain_names[2:])
    return _with_choice(blocks, chosen).mapInArrow(run, schema)


def mean_prediction(rows: DataFrame, members: Sequence[str]) -> DataFrame:
    columns = [F.col(m) for m in members]
    return rows.withColumn("prediction", sum(columns[1:], columns[0]) / len(columns))
