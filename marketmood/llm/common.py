"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.storage import new_path

# Rows of long texts make large Arrow batches; this bounds a batch by bytes.
BATCH_BYTES = 8 * 1024 * 1024
# A table is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 40 * 1024 * 1024
SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by bytes, not by rows only.

    For the owner of a session (the queries, the pipeline); operators set nothing.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function whose output comes in batches of about BATCH_BYTES at most.

    The batch is cut here and not by Spark, whose limit for output batches fails a task
    that yields a batch below the limit and later one above it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
        # Workers live on from task to task; what a task needed goes back to the machine.
        pa.default_memory_pool().release_unused()

    return cut


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of a table in memory, about: 16 a value, and what strings and arrays hold."""
    total = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = 40 if isinstance(field.dataType.elementType, T.StructType) else 16
            total = total + width * F.greatest(F.size(field.name), F.lit(0))
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def if_small(df: DataFrame) -> DataFrame:
    """``df`` (already written, or as cheap) marked for broadcast if its size allows."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0)).cast("int")


def by_batch(work: Callable[[dict], dict], schema: pa.Schema):
    """A ``mapInArrow`` function from a function over columns given as Python lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
            yield pa.RecordBatch.from_pydict(work(columns), schema=schema)

    return run


def texts_of(column: pa.Array) -> list[str | None]:
    """Strings of a text column; bytes that are not UTF-8 become U+FFFD."""
    return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` breaks at exactly these six bytes."""
    return text.split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (uint64)."""
    x = values.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, alike in every Python worker.

    ``hash`` of bytes depends on a seed per process, hence xxhash.
    """
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter(map(digest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total *= _MULTIPLIER
            total += hashes[i : i + n]
        return mix(total)


def added_schema(df: DataFrame, carried: list[str], added: dict[str, str]) -> T.StructType:
    """The schema of the carried columns of ``df`` followed by the added ones."""
    fields = [df.schema[c] for c in carried]
    return T.StructType([*fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in added.items()))])
