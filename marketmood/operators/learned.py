"""A trained text classifier, and batch inference with a model of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer, StringIndexerModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.functions.labels import LABELS, NEUTRAL, SENTIMENT_WORDS, best_label, recode, softmax
from marketmood.functions.text import has_text

_WORDS = (
    "SELECT *, regexp_extract_all(lower(coalesce(text, '')), "
    r"'[\\p{L}\\p{N}_]{2,}', 0) AS _words FROM __THIS__"
)


def fit(
    specific: DataFrame,
    general: DataFrame | None = None,
    features: int = 1 << 16,
    max_iter: int = 20,
    reg: float = 0.01,
) -> PipelineModel:
    """Multinomial logistic regression on hashed TF-IDF words of (text, label) rows.

    The general corpus comes first, the specific one is added to it. Hashing
    bounds the model whatever the vocabulary, and each iteration is one
    tree-aggregated pass.
    """
    rows = specific.select("text", "label")
    if general is not None:
        rows = general.select("text", "label").unionByName(rows)
    index = StringIndexerModel.from_labels(list(LABELS), inputCol="label", outputCol="_label")
    rows = index.transform(rows)
    return Pipeline(
        stages=[
            SQLTransformer(statement=_WORDS),
            HashingTF(numFeatures=features, inputCol="_words", outputCol="_counts"),
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features",
                labelCol="_label",
                family="multinomial",
                maxIter=max_iter,
                regParam=reg,
                rawPredictionCol="_raw",
                probabilityCol="_probability",
                predictionCol="_prediction",
            ),
        ]
    ).fit(rows)


def predict(docs: DataFrame, model: PipelineModel, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, one probability per label and ``prediction``; no shuffle."""
    scored = model.transform(docs.select(*keep, F.col(text).alias("text")))
    share = vector_to_array("_probability")
    # Labels absent from the training rows get no entry and probability 0.
    columns = {l: F.coalesce(F.get(share, F.lit(i)), F.lit(0.0)) for i, l in enumerate(LABELS)}
    shares = scored.select(*keep, *[c.alias(l) for l, c in columns.items()])
    return shares.withColumn("prediction", best_label({l: F.col(l) for l in LABELS}))


def from_logits(rows: DataFrame, logits: dict[str, str]) -> DataFrame:
    """Add softmax probabilities and the arg-max label of one logit column per label."""
    scores = {label: F.col(column) for label, column in logits.items()}
    shares = dict(zip(scores, softmax(list(scores.values()))))
    return rows.withColumns({"prediction": best_label(scores), **shares})


def infer(
    docs: DataFrame,
    make_predict_fn: Callable,
    dim: int,
    text: str = "cleaned_text",
    batch_size: int = 32,
) -> DataFrame:
    """Add ``sentiment`` and ``embedding`` computed by a user's model.

    ``make_predict_fn`` runs once per Python worker, loads the model and returns
    a function from a text array to ``{"sentiment": ..., "embedding": ...}``.
    Batches travel by Arrow. Rows without text get neutral and the zero vector. Labels
    may be the library's or positive, neutral and negative; NULL becomes neutral, any
    other word is an error.
    """
    output = T.StructType.fromDDL("sentiment string, embedding array<float>")
    model = predict_batch_udf(make_predict_fn, return_type=output, batch_size=batch_size)
    filled = docs.withColumn("_out", model(F.coalesce(F.col(text), F.lit(""))))
    there = F.coalesce(has_text(F.col(text)), F.lit(False))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    label = _known_label(F.col("_out.sentiment"))
    return filled.withColumns(
        {
            "sentiment": F.when(there, label).otherwise(NEUTRAL),
            "embedding": F.when(there, F.col("_out.embedding")).otherwise(zero),
        }
    ).drop("_out")


def _known_label(said: Column) -> Column:
    """A model's word in the library's labels; NULL becomes neutral, any other word is an error."""
    return F.coalesce(
        recode(said, {**{l: l for l in LABELS}, **SENTIMENT_WORDS}),
        F.when(said.isNotNull(), F.raise_error(F.concat(F.lit("unknown sentiment: "), said)).cast("string")),
        F.lit(NEUTRAL),
    )


class TokenModel(Protocol):
    """What a worker loads: tokens of a text, and token vectors and label scores of a padded batch."""

    labels: Sequence[str]

    def tokens(self, text: str) -> Sequence[int]: ...

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, places, dim) vectors and (chunks, labels) scores of (chunks, places) ids."""


def _buckets(sizes: list[int], batch_tokens: int) -> Iterator[list[int]]:
    """Places of chunks batched by length: a batch pads to its longest, at most ``batch_tokens`` in all."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        # Sorted by size, the new chunk is the longest; a batch holds lengths of one power of two.
        if batch and ((len(batch) + 1) * sizes[i] > batch_tokens or sizes[i].bit_length() > sizes[batch[0]].bit_length()):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def pooled(model: TokenModel, texts: list[str | None], dim: int, chunk_tokens: int, batch_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its mean token vector, its mean label scores and its tokens.

    Long texts are cut into chunks; a text's scores are its chunks' weighed by their
    tokens. Places that only pad a batch count for nothing.
    """
    owners, chunks = [], []
    for i, text in enumerate(texts):
        ids = list(model.tokens(text or ""))
        for at in range(0, len(ids), chunk_tokens):
            owners.append(i)
            chunks.append(ids[at : at + chunk_tokens])
    vectors, scores, counts = np.zeros((len(texts), dim)), np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    for batch in _buckets([len(c) for c in chunks], batch_tokens):
        longest = max(len(chunks[i]) for i in batch)
        ids, mask = np.zeros((len(batch), longest), np.int64), np.zeros((len(batch), longest), bool)
        for row, i in enumerate(batch):
            ids[row, : len(chunks[i])] = chunks[i]
            mask[row, : len(chunks[i])] = True
        found, said = model(ids, mask)
        own = [owners[i] for i in batch]
        sizes = mask.sum(axis=1)
        np.add.at(vectors, own, (found * mask[:, :, None]).sum(axis=1, dtype=np.float64))
        np.add.at(scores, own, said * sizes[:, None])
        np.add.at(counts, own, sizes)
    some = np.maximum(counts, 1)[:, None]
    return vectors / some, scores / some, counts


def infer_pooled(
    docs: DataFrame,
    make_model: Callable[[], TokenModel],
    dim: int,
    text: str = "cleaned_text",
    chunk_tokens: int = 512,
    batch_tokens: int = 1 << 14,
) -> DataFrame:
    """Add ``sentiment`` and ``embedding``, the mean of a user model's token vectors.

    The model is loaded once per task and called on padded batches of at most
    ``batch_tokens`` places (or one chunk), of chunks of like length, so neither one long
    text among short ones nor many long ones grow a batch. Every token of a text counts.
    The label is that of the highest score, the first on a tie. Rows without text or
    tokens get neutral and the zero vector. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("sentiment", "embedding")]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL("_said string, embedding array<float>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            vectors, scores, counts = pooled(model, batch.column(text).to_pylist(), dim, chunk_tokens, batch_tokens)
            best = scores.argmax(axis=1) if len(scores) else []
            said = [model.labels[b] if n else None for b, n in zip(best, counts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(said, pa.string()), pa.array(list(vectors.astype("float32")), pa.list_(pa.float32()))],
                [*kept, "_said", "embedding"],
            )

    found = docs.select(*kept).mapInArrow(run, schema)
    return found.withColumn("sentiment", _known_label(F.col("_said"))).select(*kept, "sentiment", "embedding")
