"""Contiguous shards of near-equal bytes, from global prefix sums of row sizes.

Rows are put in one global order by ranges. A pass over each range gives running sums
within it; the ranges' totals, one row each, give what stands before a range. A row's
place in the whole is the sum of both, and shards are cut at equal targets of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import sliced, stored

SHARDS = 8
# A cut inside a run of equal texts moves to the run's nearer end if that costs at most
# this share of a shard; a larger run is divided at the target itself.
TOLERANCE = 0.02


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number, and bytes and rows of the range before each row."""
    part = TaskContext.get().partitionId()
    size_so_far = rows_so_far = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        ends = size_so_far + np.cumsum(sizes)
        before = ends - sizes
        places = rows_so_far + np.arange(len(sizes))
        size_so_far, rows_so_far = int(ends[-1]) if len(ends) else size_so_far, rows_so_far + len(sizes)
        added = [pa.array(np.full(len(sizes), part, np.int64)), pa.array(before.astype(np.int64)), pa.array(places.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "before", "place"])


def assign_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    size is the UTF-8 bytes of the text plus 1 (1 for null). Rows are ordered by the MD5
    of the text and then by id, so equal texts stand together: they share a shard unless
    a cut falls inside their run and moving it would unbalance the shards. A shard's size
    is off the target by at most one row and twice the tolerance. slot counts from 0 in
    each shard without gaps; which of several equal rows gets which slot is not defined.
    text_crc32 of a null text is that of an empty one. Empty tables give no rows; other columns are not
    read. A text of any number of copies is divided among ranges by id.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"),
    )
    order = ["digest", "doc_id", "size"]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = stored(
        ordered.mapInArrow(sliced(_running), "doc_id long, size long, text_crc32 long, digest binary, part long, before long, place long"),
        "placed",
    )
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    offsets, bytes_before, rows_before = [], 0, 0
    for r in totals:
        offsets.append((r["part"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["bytes"], rows_before + r["rows"]
    starts = spark.createDataFrame(offsets, "part long, bytes_before long, rows_before long")
    # One row per range: as many as there are partitions, whatever the number of rows.
    whole = placed.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32", "digest",
        (F.col("before") + F.col("bytes_before")).alias("start"),
        (F.col("place") + F.col("rows_before")).alias("row"),
    )
    cuts = _cuts(whole, bytes_before, shards, tolerance)
    first = sum(((F.col("start") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    sharded = whole.select("doc_id", "size", "text_crc32", first.alias("shard"), "row")
    # At most one row per shard.
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )


def _cuts(whole: DataFrame, total: int, shards: int, tolerance: float) -> list[int]:
    """Where shards 1, 2, ... begin, in bytes: the targets, moved to ends of runs where cheap."""
    targets = [-(-total * k // shards) for k in range(1, shards)]
    if not total:
        return targets
    over = [(F.col("start") <= F.lit(t)) & (F.lit(t) < F.col("start") + F.col("size")) for t in targets]
    hit = over[0]
    for condition in over[1:]:
        hit = hit | condition
    # At most one row per cut, and then one run per cut.
    digests = whole.filter(hit).select("digest").distinct()
    runs = (
        whole.join(F.broadcast(digests), "digest")
        .groupBy("digest")
        .agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high"))
        .collect()
    )
    cuts = []
    for target in targets:
        run = next((r for r in runs if r["low"] <= target < r["high"]), None)
        near = min((run["low"], run["high"]), key=lambda e: (abs(e - target), e)) if run else target
        cuts.append(near if abs(near - target) <= tolerance * total / shards else target)
    return cuts
