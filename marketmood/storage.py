"""Written intermediate tables and the size check before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
# Pieces of the rarer rows of a table that are broadcast in turn; more are joined by a shuffle.
PIECES = 4
_FIELD_BYTES = 16

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Unset on a local master (tests, bench) one temporary folder per session stands in.
    On any other master an unset folder, or one under a temporary folder of the
    machine or the session's scratch space, is an error: it would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if configured:
        path = urlparse(configured)
        own = path.scheme in ("", "file") and _on_one_machine(path.path, spark.conf.get("spark.local.dir", None))
        if own and not context.master.startswith("local"):
            raise ValueError(f"{configured} is on one machine; name a folder shared by the cluster")
        return configured
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="marketmood-")
    return _local_dirs[context.applicationId]


def _on_one_machine(path: str, scratch: str | None) -> bool:
    """Whether a path lies under a folder that every machine has for itself."""
    folders = {"/tmp", "/var/tmp", "/dev/shm", tempfile.gettempdir(), *(scratch or "").split(",")} - {""}
    place = PurePosixPath(path)
    return any(place.is_relative_to(folder) for folder in folders)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends at the files.

    Used where a result feeds several branches (fitted models, daily tables).
    Unlike a cache it outlives lost executors, and its file sizes give the
    planner real statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Estimated in-memory size of a table of flat columns, in one aggregate."""
    size = F.lit(_FIELD_BYTES * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a written or otherwise cheap table may be broadcast; it is read once."""
    return table_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else as it is.

    Beyond the limit the join shuffles, and adaptive execution splits a hot key.
    Call it on written or otherwise cheap tables: the check reads them once.
    """
    return F.broadcast(df) if fits(df, limit) else df


def in_pieces(
    words: DataFrame, table: DataFrame, key: str, how: str = "inner", often: Column | None = None, limit: int | None = None
) -> DataFrame:
    """``words`` joined with a written ``table`` on ``key``; ``words`` are read at most three times.

    A table within ``limit`` is broadcast. Of a larger one the rows met most that fit are
    broadcast, which settles nearly all words where they are. Words these rows lack are
    written once and meet the rest of the table: by broadcast of up to PIECES pieces in turn,
    cut by the hash of the key, or, if it is larger, by a shuffle of those few words. Time so
    grows with words and table, not with their product. ``often`` is higher for rows of the
    table that are met more; without it the words are counted first. Inner and semi joins
    only, so the parts' rows add up.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    size = table_bytes(table)
    if size <= limit:
        return words.join(F.broadcast(table), key, how)
    ranked = written(_ranked(words, table, key, often), "ranked")
    bound = ranked.agg(F.percentile_approx("_often", 1 - limit / size, 10_000)).first()[0]
    met_most = F.col("_often") > F.lit(bound)
    most, rest = ranked.filter(met_most).drop("_often"), ranked.filter(~met_most).drop("_often")
    lacking = written(words.join(F.broadcast(most.select(key)), key, "left_anti"), "lacking")
    count = -(-table_bytes(rest) // limit)
    parts = [words.join(F.broadcast(most), key, how)]
    if count > PIECES:
        parts.append(lacking.join(rest, key, how))
    else:
        place = F.pmod(F.xxhash64(key), F.lit(count))
        parts += [lacking.join(F.broadcast(rest.filter(place == i)), key, how) for i in range(count)]
    return reduce(DataFrame.unionByName, parts)


def _ranked(words: DataFrame, table: DataFrame, key: str, often: Column | None) -> DataFrame:
    """``table`` with ``_often``, which is the same in all rows of a key and never NULL."""
    if often is None:
        met = words.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_often"))
        return table.join(met, key, "left").fillna(0.0, ["_often"])
    highest = F.max(often.cast("double")).over(Window.partitionBy(key))
    return table.withColumn("_often", F.coalesce(highest, F.lit(float("-inf"))))
