"""Sums of dense arrays over tasks: gradients and Gram matrices in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Tasks that add up the others' sums; the driver gets one array of each.
FAN = 4


def _row(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.astype("<f8").tobytes()], pa.binary())], ["sums"])


def summed(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], width: int) -> np.ndarray:
    """The sum over all tasks of what ``add`` adds to an array of ``width`` doubles per batch.

    A task keeps one array, whatever its rows; the tasks' arrays are added up by FAN
    tasks, and the driver adds their results. ``width`` must not depend on the rows.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                add(batch, sums)
        if any_rows:
            yield _row(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width)
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                sums += np.frombuffer(raw, "<f8")
        yield _row(sums)

    parts = rows.mapInArrow(own, "sums binary").repartition(FAN).mapInArrow(merged, "sums binary")
    total = np.zeros(width)
    for row in parts.toLocalIterator():
        total += np.frombuffer(bytes(row["sums"]), "<f8")
    return total
