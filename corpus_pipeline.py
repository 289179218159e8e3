"""A training-data pipeline over ``documents``: filter, deduplicate, clean, encode.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, except
the last, which adds the token ids. ``run`` applies the stages in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.llm import bpe, decontaminate, jaccard_join, quality_rules, substring_dedup
from marketmood.llm.common import bound_batches, stored
from marketmood.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep; the rest go."""
    forest = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score_quality(docs, forest).filter(F.col("kept")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    bound_batches(spark)
    return jaccard_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id also has.

    n_chars follows the shortened text; a document of repeated passages alone keeps its
    row with an empty text.
    """
    bound_batches(spark)
    cut = substring_dedup.remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; decoded_sha256 shows that the ids decode to the text."""
    bound_batches(spark)
    return bpe.encode_texts(docs, tokenizer(), with_text=False)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encode_stage),
]
# Trees, automata and byte merges have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
