"""Quality rules: base rules and gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm import trees
from marketmood.llm.common import added_schema, by_batch, sliced, split_words, window_hashes, word_hashes

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
KEEP_FROM = 0.5
# Labelled rows the trees are fitted on, at most; all are used where there are fewer.
TRAINING_ROWS = 12_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = {c: "long" for c in COUNTS} | {"base_failed": "boolean", "kept": "boolean", "quality": "double"}
FEATURES = (
    "log_words",
    "word_length",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digits_per_char",
    "marks_per_word",
    "distinct_share",
    "words_per_line",
)
# More symbols, repeated lines or repeated windows never raise the score.
MONOTONE = {
    FEATURES.index("symbols_per_word"): -1,
    FEATURES.index("dup_line_share"): -1,
    FEATURES.index("repeat_share"): -1,
}

# Byte classes: 0 other, 1 white space, 2 continuation, 3 symbol, 4 upper, 5 lower, 6 digit, 7 mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[0x80:0xC0] = 2
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[ord("a") : ord("z") + 1] = 5
_CLASS[ord("0") : ord("9") + 1] = 6
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 7
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 3


def repeat_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that stand twice or more in the text."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(len(windows), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int((step.cumsum()[:-1] > 0).sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def describe(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of one text and its features for the trees."""
    text = text or b""
    words = split_words(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    n, chars = len(words), int(len(text) - kinds[1] - kinds[2])
    lines, dups = dup_lines(text)
    repeats = repeat_words(word_hashes(words))
    per = max(n, 1)
    features = (
        float(np.log1p(n)),
        chars / per,
        int(kinds[3]) / per,
        dups / max(lines, 1),
        repeats / per,
        int(kinds[4]) / max(int(kinds[4] + kinds[5]), 1),
        int(kinds[6]) / max(chars, 1),
        int(kinds[7]) / per,
        len(set(words)) / per,
        n / max(lines, 1),
    )
    return (n, chars, int(kinds[3]), dups, repeats), features


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, chosen by the hash of the id.

    The chosen labels are few by ``rows`` and so may be broadcast: no text moves.
    Of a repeated id one row counts; null ids and labels none.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("features", pa.list_(pa.float64()))])

    def work(c: dict) -> dict:
        return {
            "doc_id": c["doc_id"],
            "label": [int(v) for v in c["label"]],
            "features": [list(describe(t)[1]) for t in c["text"]],
        }

    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(sliced(by_batch(work, schema)), "doc_id long, label long, features array<double>")
        .groupBy("doc_id")
        .agg(F.min(F.struct("label", "features")).alias("row"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["row"]["features"] for r in found], float).reshape(len(found), len(FEATURES))
    return x, np.array([r["row"]["label"] for r in found], float)


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> trees.Forest:
    """Trees for ``labels.quality``; constant, and for keeping, where nothing is labelled."""
    x, y = training_sample(docs, labels, rows)
    forest = trees.fit(x, y, MONOTONE)
    if not len(y):
        forest.base = 10.0
    return forest


def score_quality(
    docs: DataFrame,
    forest: trees.Forest,
    carry: list[str] | None = None,
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Judge every whole text: the columns of ``docs`` with counts and verdicts added.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean) and quality (double). ``carry`` names the columns of
    ``docs`` to return, all by default; those with an added name are replaced. A null
    or empty text has no words and fails the base rules; repeated rows and null ids
    are judged like any other row. One pass over the rows, nothing is shuffled.
    """
    carried = [c for c in carry or docs.columns if c not in ADDED]
    source = docs.select(*dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = np.array([r[0] for r in rows], np.int64).reshape(len(rows), len(COUNTS))
            score = forest.score(np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES)))
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            columns = [*(batch.column(c) for c in carried), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
            columns += [pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, *ADDED])

    return source.mapInArrow(sliced(run), added_schema(docs, carried, ADDED))
