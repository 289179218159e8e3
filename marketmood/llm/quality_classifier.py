"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from text labelled good, one from text labelled bad. The
difference of the two compressed sizes, per byte of text, is calibrated to a
probability on labelled texts that took no part in the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import added_schema, sliced

# Long texts are compressed piece by piece, so that the dictionary counts throughout.
PIECE_BYTES = 2048
# Bounds of the fit: labelled rows used, and pieces of text of each label for its dictionary.
LABELLED_ROWS = 10_000
PIECES_PER_LABEL = 3_000
DICTIONARY_BYTES = 112 * 1024
LEVEL = 3
THRESHOLD = 0.7


def pieces(text: bytes | None) -> list[bytes]:
    text = text or b""
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)


def difference(text: bytes | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of text; 0 without text."""
    parts = pieces(text)
    if not parts:
        return 0.0
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / len(text)


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def probability(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps with a small ridge."""
    if not len(y):
        return 0.0, 0.0
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -500, 500)))
        gradient = design.T @ (p - y) + 0.01 * weights
        curvature = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, where: Column, rows: int = LABELLED_ROWS) -> Classifier:
    """Learn from at most ``rows`` labelled ids for which ``where`` (over doc_id) holds.

    The ids are chosen by their hash; every second one serves the dictionaries, the rest
    the calibration. Labels are few by ``rows`` and are broadcast, so no text moves;
    PIECES_PER_LABEL pieces of text per label reach the driver. Null ids and labels do
    not count; of a repeated id the larger label holds, all its texts serve a dictionary
    and one of them the calibration. Without labels every text scores 0.5.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(where)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    labelled = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [pieces(t) for t in batch.column("text").to_pylist()]
            ids, found = batch.column("doc_id").to_pylist(), [p for part in own for p in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, part in zip(ids, own) for _ in part], pa.int64()),
                    pa.array([n for part in own for n in range(len(part))], pa.int32()),
                    pa.array(found, pa.binary()),
                ],
                ["doc_id", "piece", "text"],
            )

    def samples(label: int) -> list[bytes]:
        rows = labelled.filter((half == 0) & (F.col("label") == label)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        cuts = rows.mapInArrow(sliced(cut), "doc_id long, piece int, text binary").distinct()
        found = cuts.orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "text").limit(PIECES_PER_LABEL)
        return [bytes(r["text"]) for r in found.collect()]

    model = Classifier(dictionary(samples(1)), dictionary(samples(0)), 0.0, 0.0)
    measured = (
        compare(labelled.filter(half == 1), model, ["doc_id", "label"])
        .groupBy("doc_id")
        .agg(F.min(F.struct("label", "difference")).alias("row"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["row"]["difference"] for r in measured], float)
    y = np.array([r["row"]["label"] for r in measured], float)
    model.slope, model.offset = calibrate(x, y)
    return model


def compare(docs: DataFrame, model: Classifier, carried: list[str]) -> DataFrame:
    """The carried columns with difference, score (double) and predicted (int)."""
    added = {"difference": "double", "score": "double", "predicted": "int"}
    source = docs.select(*dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(model.good), compressor(model.bad)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([difference(t, good, bad) for t in texts], float)
            score = model.probability(found)
            columns = [pa.array(found), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], [*carried, *added])

    return source.mapInArrow(sliced(run), added_schema(docs, carried, added))


def classify(docs: DataFrame, model: Classifier, carry: list[str] | None = None) -> DataFrame:
    """Score every whole text: score (0 to 1, higher where label 1 is likelier) and predicted.

    A null or empty text has difference 0 and gets the probability belonging to it.
    Columns of ``docs`` (or those in ``carry``) come first, those with an added name are
    replaced. One pass, nothing is shuffled; repeated rows and null ids stay.
    """
    carried = [c for c in carry or docs.columns if c not in ("difference", "score", "predicted")]
    return compare(docs, model, carried)
