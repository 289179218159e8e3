"""Sinks of tables, metrics, parameters and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.sources.schemas import BACKTEST, BLEND


def write_by_ticker(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per ticker; overwriting replaces only tickers written.

    Rebalancing packs small tickers together and splits a large one over several
    files and tasks.
    """
    (
        df.hint("rebalance", "ticker")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet without partitions, for the market index."""
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table as written. Tickers are text: folder names never decide their type.

    Without ``schema`` the files' own schema holds, with ``ticker`` a string.
    """
    if schema is None:
        found = spark.read.parquet(path)
        fields = [T.StructField(f.name, T.StringType() if f.name == "ticker" else f.dataType) for f in found.schema]
        return spark.read.schema(T.StructType(fields)).parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one metrics row as JSON."""
    metrics.write.mode("overwrite").json(path)


def metrics_text(metrics: DataFrame, name: str) -> DataFrame:
    """The metrics as lines of text with four decimals, in one ``value`` column."""
    shown = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1-Score"}
    lines = [F.lit(f"{name} Performance:")] + [
        F.concat(F.lit(f"{title}: "), F.format_string("%.4f", F.col(column)))
        for column, title in shown.items()
    ]
    return metrics.select(F.concat_ws("\n", *lines).alias("value"))


def write_metrics_text(metrics: DataFrame, name: str, path: str) -> None:
    metrics_text(metrics, name).write.mode("overwrite").text(path)


def write_backtest_metrics(metrics: DataFrame, path: str) -> None:
    """JSON, one folder per ticker; only the tickers written are replaced.

    A folder costs far more than the bytes of its row, by which adaptive execution would
    give all rows to one task, so they are dealt to as many as a shuffle has, by a hash of
    the ticker: dealt by the ticker itself, rows grouped by it would stay where they are.
    """
    (
        metrics.repartition(_tasks(metrics.sparkSession), F.xxhash64("ticker"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .json(path)
    )


def read_backtest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all tickers as written, in few tasks; Spark alone would read a few small files in each."""
    return spark.read.schema(BACKTEST).json(path).coalesce(_tasks(spark))


def _tasks(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_blend(best: DataFrame, path: str) -> None:
    """The tuned threshold and weight as one JSON row."""
    best.select("pos_thresh", "weight").write.mode("overwrite").json(path)


def read_blend(spark: SparkSession, path: str) -> tuple[float, float]:
    row = spark.read.schema(BLEND).json(path).first()
    return row["pos_thresh"], row["weight"]
