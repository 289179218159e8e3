"""URL filters as a sort-merge range join of pages with host-and-path rules.

A host is keyed by its labels in reverse, so the pages of a host and of all its
subdomains are one interval of keys and the intervals of rules nest. Pages are cut
into key ranges, each rule is placed where its interval begins and again at the start
of every later range it reaches into, and a sorted sweep of each range keeps a stack
of the rules whose intervals are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.llm.common import sliced

DEFAULT_VERDICT = "allow"
# Sampled keys per range: they decide where ranges end, never which rows are read.
KEYS_PER_RANGE = 50
# Ranges, and so sampled keys that reach the driver.
MOST_RANGES = 10_000
_END = "\x01"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; an empty string without it or for null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels in reverse, each closed by a byte below all that stand in host names."""
    return F.concat_ws(_END, F.reverse(F.split(host, "[.]", -1)), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


class OpenRules:
    """The rules of the intervals that the sweep stands in, outermost first."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def enter(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.enter(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        if path not in paths:
            paths[path] = verdict
            if len(path) not in lengths:
                lengths.append(len(path))
                lengths.sort(reverse=True)
        else:
            paths[path] = max(paths[path], verdict)  # block over allow

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest open rule that fits, else nulls."""
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        for _, rule_host, paths, lengths in self.stack:
            if host != rule_host and not host.endswith("." + rule_host):
                continue
            for length in lengths:
                start = path[:length]
                if len(start) == length and start in paths:
                    best = max(best, (len(rule_host) + length, len(rule_host), rule_host + start, paths[start]), key=lambda x: x[:2])
                    break
        return best[2], best[3]


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page row.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains where the page's path starts with the rule's; the longest wins (characters
    of host and path, then of the host; of equal rules block). Without a fitting rule
    ``rule`` is null and ``verdict`` is ``default``. A null url, or one without ``://``,
    has an empty host and path. Rules with a null host or verdict are left out, a null
    path counts as empty, hosts are lower-cased (A-Z). Repeated pages stay; other
    columns are not read.

    Ranges end at keys sampled by hash, with a hash of the page as a second key, so a
    host with a third of all pages is spread over many ranges. A rule is repeated once
    per range it reaches into; at any range start the open rules belong to suffixes of
    one host, so the repeats are few.
    """
    spark = pages.sparkSession
    ranges = ranges or min(MOST_RANGES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    salt = F.xxhash64("page_id", "url")
    rows = rows.select("page_id", "host", "path", key_of(F.col("host")).alias("key"), salt.alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"))
    sample = rows.select("key", "salt").orderBy(F.xxhash64("salt"), "key").limit(KEYS_PER_RANGE * ranges)
    bounds = sorted((r["key"].encode(), r["salt"]) for r in sample.collect())
    bounds = sorted({bounds[i * len(bounds) // ranges] for i in range(1, ranges)}) if bounds else []

    bound_keys = pa.array([k for k, _ in bounds], pa.binary())
    salts = np.array([s for _, s in bounds], np.int64)
    keys = np.array([k for k, _ in bounds], object)

    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        raw = np.array([k.encode() for k in key], object)
        low, high = np.searchsorted(keys, raw, "left"), np.searchsorted(keys, raw, "right")
        out = low.astype(np.int32)
        for i in np.flatnonzero(low < high):
            out[i] = low[i] + np.searchsorted(salts[low[i] : high[i]], salt.iloc[i], "right")
        return pd.Series(out)

    host = F.translate(F.col("host"), _UPPER, _UPPER.lower())
    rule_rows = rules.filter("host is not null and verdict is not null").select(
        host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict", key_of(host).alias("key")
    )
    lowest = -(2**63)
    found = np.array(bound_keys.to_pylist(), object)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges_of(key: pd.Series) -> pd.Series:
        """The range a rule's interval begins in, and those whose start lies inside it."""
        out = []
        for k in key:
            raw = k.encode()
            first = int(np.searchsorted(found, raw, "left"))
            last = first
            while last < len(found) and found[last].startswith(raw):
                last += 1
            out.append(list(range(first, last + 1)))
        return pd.Series(out)

    opened = rule_rows.select(
        F.lit(None).cast("long").alias("page_id"), "host", "path", "key", F.lit(lowest).alias("salt"), F.lit(0).alias("kind"), "verdict",
        F.explode(ranges_of("key")).alias("part"),
    )
    both = rows.withColumn("part", range_of("key", "salt")).unionByName(opened)
    # Rules of a range come before its pages: sorted by key, then kind.
    parts = both.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind", "salt")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rules = OpenRules()
        for batch in batches:
            c = {n: v.to_pylist() for n, v in zip(batch.schema.names, batch.columns)}
            out = []
            for page_id, host, path, key, kind, verdict in zip(*(c[n] for n in ("page_id", "host", "path", "key", "kind", "verdict"))):
                if kind == 0:
                    open_rules.open(key, host, path, verdict)
                else:
                    open_rules.enter(key)
                    rule, judged = open_rules.judge(host, path)
                    out.append((page_id, host, path, rule, judged or default))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["page_id", "host", "path", "rule", "verdict"])

    schema = "page_id long, host string, path string, rule string, verdict string"
    return parts.select("page_id", "host", "path", "key", "kind", "verdict").mapInArrow(sliced(sweep), schema)
