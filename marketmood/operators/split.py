"""Seeded, repeatable splits into train and test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.storage import small

TEST_SHARE = 0.2
_BUCKET = 4  # hex digits: 65,536 buckets


def _digest(keys: Sequence[str], seed: int) -> Column:
    """MD5 of the key columns; seed 0 hashes the plain keys."""
    return _hashed([F.col(k) for k in keys], seed)


def _hashed(keys: Sequence[Column], seed: int) -> Column:
    parts = [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, *([F.lit(str(seed))] if seed else [])))


def hash_split(
    df: DataFrame, keys: Sequence[str], share: float = TEST_SHARE, seed: int = 0
) -> DataFrame:
    """Add ``is_test`` from a hash of the keys: no shuffle, stable per row."""
    return df.withColumn("is_test", in_test([F.col(k) for k in keys], share, seed))


def in_test(keys: Sequence[Column], share: float = TEST_SHARE, seed: int = 0) -> Column:
    """Whether the row with these keys is a test row of ``hash_split``."""
    place = F.conv(F.substring(_hashed(keys, seed), 1, 8), 16, 10).cast("long")
    return place < int(share * 16**8)


def exact_split(
    df: DataFrame,
    keys: Sequence[str],
    share: float = TEST_SHARE,
    strata: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Add ``is_test`` for exactly ceil(share * n) rows, per stratum if named.

    The test rows are those of lowest key hash. The hash of the last one is found
    by counting rows per hash prefix (at most 65,536 counts per stratum) and
    ranking only the one bucket the cut falls into, so the rows themselves are
    neither sorted nor moved. ``keys`` must identify a row. ``df`` is read three
    times: pass it written if it is costly.
    """
    group = F.col(strata) if strata else F.lit("all")
    narrow = df.select(group.alias("_group"), _digest(keys, seed).alias("_digest")).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET)
    )
    ordered = Window.partitionBy("_group").orderBy("_bucket")
    counts = narrow.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(ordered))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy("_group")))
        .withColumn("_wanted", F.ceil(F.round(F.col("_total") * share, 9)))
        .filter(
            (F.col("_upto") >= F.col("_wanted"))
            & (F.col("_upto") - F.col("_n") < F.col("_wanted"))
        )
        .select(
            "_group", "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rest")
        )
    )
    last = (
        narrow.join(cut, ["_group", "_bucket"])
        .withColumn(
            "_rank", F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_digest"))
        )
        .filter(F.col("_rank") == F.col("_rest"))
        .select("_group", F.col("_digest").alias("_last"))
    )
    if strata is None:
        # One cut for all rows: a literal, not a join with a one-row table.
        found = last.first()
        below = _digest(keys, seed) <= F.lit(found["_last"] if found else "")
        return df.withColumn("is_test", below)
    return (
        df.withColumn("_group", group)
        .join(small(last), "_group", "left")
        .withColumn(
            "is_test", F.coalesce(_digest(keys, seed) <= F.col("_last"), F.lit(False))
        )
        .drop("_group", "_last")
    )


def time_split(df: DataFrame, date: str, share: float = TEST_SHARE) -> DataFrame:
    """Add ``is_test`` for the latest dates holding at least ``share`` of the rows.

    Whole dates only, so overlapping sequences of one date stay together. Works
    on row counts per date.
    """
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    marked = counts.select(
        date,
        (
            F.coalesce(F.sum("_n").over(later), F.lit(0)) < F.sum("_n").over(whole) * share
        ).alias("is_test"),
    )
    return df.join(marked, date)
