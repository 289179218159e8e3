"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.llm import (
    bpe,
    conversation_trie,
    decontaminate,
    jaccard_join,
    language,
    lexical_search,
    licenses,
    quality_classifier,
    quality_rules,
    shards,
    substring_dedup,
    url_rules,
    vector_search,
)
from marketmood.llm.common import bound_batches, fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session is set to batches bounded by bytes."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> bpe.Tokenizer:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.read_tokenizer(path, public_tokenizers.PATTERN)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score_quality(docs, forest, carry=["doc_id"])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality_classifier.classify(docs, model, carry=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign_shards(table(spark, sf_dir, "documents"))
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, tokenizer(), carry=["doc_id"], with_ids=False, with_text=False)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = language.fit(docs, ~held_out)
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_quality_rules,
        op3_quality_classifier,
        op4_url_rules,
        op5_sharding,
        op6_decontamination,
        op7_byte_bpe,
        op8_licenses,
        op9_substring_dedup,
        op10_language,
        op11_prefix_trie,
        op12_vector_topk,
        op13_ranked_search,
    )
}
