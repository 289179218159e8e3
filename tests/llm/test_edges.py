"""Very long texts among short ones, empty tables, repeated rows and clashing names, for every operator."""

from __future__ import annotations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marketmood.llm import (
    bpe,
    decontaminate,
    jaccard_join,
    language,
    lexical_search,
    licenses,
    quality_classifier,
    quality_rules,
    shards,
    substring_dedup,
    trees,
)
from marketmood.llm.common import BATCH_BYTES, sliced
from marketmood.llm.queries import tokenizer


def forest():
    return trees.fit(np.empty((0, len(quality_rules.FEATURES))), np.empty(0), {})


def classifier():
    return quality_classifier.Classifier(b"", b"", 1.0, 0.0)


def filters():
    return language.Filters(["a"], np.array([1.0]), np.zeros((1 << 10, 1), np.uint64), language.letter_table())


def benchmark(spark):
    return spark.createDataFrame([(1, "an item that no document of these holds at all")], "item_id long, text string")


# Operators that return the rows they are given, with all columns.
KEEPING = {
    "op1": lambda docs: jaccard_join.keep_one(docs),
    "op2": lambda docs: quality_rules.score_quality(docs, forest()),
    "op3": lambda docs: quality_classifier.classify(docs, classifier()),
    "op6": lambda docs: decontaminate.clean(docs, benchmark(docs.sparkSession)),
    "op7": lambda docs: bpe.encode_texts(docs, tokenizer()),
    "op8": lambda docs: licenses.scan(docs),
    "op9": lambda docs: substring_dedup.remove_repeats(docs),
    "op10": lambda docs: language.identify(docs, filters()),
}


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Short rows, a text of 9 MB, short rows, in one task and in batches of some rows."""
    path = str(tmp_path_factory.mktemp("mixed") / "docs")
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1_150_000)), lambda i: F.concat(F.lit("w"), F.hex(i * 7))))
    own = F.concat_ws(" ", *[F.concat(F.lit(f"s{k}x"), F.col("id")) for k in range(8)])
    rows = spark.range(0, 801, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 400, words).otherwise(own).alias("text"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_a_long_text_among_short_ones(spark, mixed, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16384")
    try:
        found = KEEPING[name](mixed).agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        else:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    want = mixed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")), F.max(F.octet_length("text"))).first()
    assert want[2] > BATCH_BYTES and tuple(found) == tuple(want)[:2]


def test_long_texts_without_the_text_carried(spark, mixed):
    assert shards.assign_shards(mixed).count() == 801
    assert decontaminate.find_items(mixed, benchmark(spark)).count() == 0
    asked = spark.createDataFrame([(5, "wDEAD wBEEF w7")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical_search.ranked_documents(mixed, asked).collect()] == [400]


CLASHING = "doc_id long, text string, kept string, score string, ids string, decoded string, lang_pred string, n_words string, item string, node string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *["own"] * 8) for i, t in rows], CLASHING)


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_clashing_names_repeated_rows_and_empty_tables(spark, name):
    rows = [(1, "first text of its kind"), (2, "another one, quite unlike it"), (2, "another one, quite unlike it"), (None, None), (3, "")]
    docs = clashing(spark, rows)
    found = KEEPING[name](docs)
    assert len(set(found.columns)) == len(found.columns) and {"doc_id", "text", "item", "node"} <= set(found.columns)
    # Of equal rows the join keeps one; all others keep every row.
    assert found.count() == len(rows) - (name == "op1")
    assert {r["item"] for r in found.select("item").collect()} == {"own"}
    nothing = KEEPING[name](docs.limit(0))
    assert nothing.count() == 0 and nothing.columns == found.columns


def test_clashing_names_of_shards_and_links(spark):
    docs = clashing(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None)]).withColumn("shard", F.lit("x")).withColumn("size", F.lit("y"))
    assert sorted((r["doc_id"], r["size"]) for r in shards.assign_shards(docs).collect()) == [(1, 12), (1, 12), (2, 1)]
    assert sorted(tuple(r) for r in jaccard_join.link_documents(docs).collect()) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_bytes_that_are_no_text(spark, name):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(concat('61FF62', hex(id), 'C3')) as string)").alias("text"))
    assert KEEPING[name](docs).count() == 3


def test_output_is_cut_by_bytes():
    import pyarrow as pa

    small, large = pa.array([b"x"] * 5), pa.array([b"y" * (BATCH_BYTES // 3)] * 10)
    batches = [pa.RecordBatch.from_arrays([x], ["v"]) for x in (small, large, small, large.slice(0, 0))]
    out = list(sliced(iter)(batches))
    assert [v for b in out for v in b.column("v").to_pylist()] == [v for b in batches for v in b.column("v").to_pylist()]
    assert max(b.nbytes for b in out) <= BATCH_BYTES and min(b.num_rows for b in out) > 0


def test_flat_trees_score_as_a_walk_does():
    draw = np.random.default_rng(4)
    x = draw.uniform(0, 1, (800, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    model = trees.fit(x, y, {1: 1})
    asked = draw.uniform(-0.2, 1.2, (60, 4))
    for row, score in zip(asked, model.score(asked)):
        margin = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            margin += model.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_score_is_that_of_two_compressors(spark):
    good, bad = b" ".join(b"good%d" % (i % 50) for i in range(3000)), b" ".join(b"bad%d" % (i % 50) for i in range(3000))
    model = quality_classifier.Classifier(good, bad, 3.0, -0.2)
    texts = ["good1 good7 good9 " * 30, "bad3 bad4 " * 40, "", None, "é" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_classifier.classify(docs, model).collect():
        raw = (texts[row["doc_id"]] or "").encode()
        sizes = []
        for content in (good, bad):
            sheet = zstandard.ZstdCompressionDict(content)
            sheet.precompute_compress(level=quality_classifier.LEVEL)
            press = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=sheet, write_content_size=False)
            step = quality_classifier.PIECE_BYTES
            sizes.append(sum(len(press.compress(raw[i : i + step])) for i in range(0, len(raw), step)))
        difference = (sizes[1] - sizes[0]) / len(raw) if raw else 0.0
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-(3.0 * difference - 0.2))))
        assert row["predicted"] == int(row["score"] >= 0.7)


def test_language_masks_are_those_of_single_filters():
    model = filters()
    model.languages, model.shares = ["a", "b"], np.array([0.4, 0.6])
    known = {0: "the quick brown fox", 1: "der schnelle braune fuchs"}
    for language_at, text in known.items():
        model.add(language_at, language.grams(text, model.letters))
    rates = model.rates()
    for text in ("the brown fox", "der braune", "quick fuchs", "xyz"):
        hashes = language.grams(text, model.letters)
        hits = [0, 0]
        for h in hashes:
            for bit in (0, 1):
                hits[bit] += all(int(model.table[int(p[0]), 0]) >> bit & 1 for p in model.places(np.array([h])))
        shares = [min(max((n / len(hashes) - r) / (1 - r), 0), 1) for n, r in zip(hits, rates)]
        shares = shares if max(shares) > 0 else list(model.shares)
        said, score = model.predict(text, rates)
        assert said == "ab"[int(np.argmax(shares))] and score == pytest.approx(max(shares) / sum(shares))
