"""Text classifiers behind one interface, chosen by name.

Every model is fitted on (news_id, cleaned_text, sentiment) rows and adds, per
row, one probability column per label and ``prediction``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS
from marketmood.operators import bayes, blend, evaluate, learned, lexicon, quality, split, staged
from marketmood.sources import sinks
from marketmood.storage import written

ID, TEXT, LABEL = "news_id", "cleaned_text", "sentiment"


def _text_label(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(TEXT).alias("text"), F.col(LABEL).alias("label"))


class TextModel(ABC):
    """Train, predict, evaluate, save and load."""

    @abstractmethod
    def train(self, rows: DataFrame, general: DataFrame | None = None) -> TextModel:
        """Fit on ``rows``; ``general`` is a (text, label) corpus to start from."""

    @abstractmethod
    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        """``keep`` columns, three probabilities and ``prediction``.

        ``keep`` must identify a row.
        """

    def predict(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        return self.predict_proba(rows, keep).select(*keep, "prediction")

    def evaluate(self, rows: DataFrame, path: str | None = None) -> DataFrame:
        """One metrics row; with ``path`` it is written with the confusion matrix."""
        said = self.predict(rows, (ID, LABEL))
        if path is not None:
            said = written(said, "predictions")
        metrics = evaluate.eval_metrics(said, LABEL)
        if path is not None:
            sinks.write_metrics(metrics, f"{path}/metrics")
            sinks.write_table(
                evaluate.confusion_matrix(said, LABEL), f"{path}/confusion_matrix"
            )
        return metrics

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def load(self, spark: SparkSession, path: str) -> TextModel: ...


class BayesModel(TextModel):
    """Naive Bayes on word counts; the model is its table of counts, which further corpora
    add to, before or after it was saved."""

    def __init__(self) -> None:
        self.counts: DataFrame | None = None
        self.weights: DataFrame | None = None

    def _with_counts(self, counts: DataFrame) -> BayesModel:
        self.counts, self.weights = counts, bayes.log_weights(counts)
        return self

    def train(self, rows: DataFrame, general: DataFrame | None = None) -> BayesModel:
        return self._with_counts(bayes.fit_counts(_text_label(rows), general))

    def start(self, corpus: DataFrame) -> BayesModel:
        """Fit on a (text, label) corpus alone; its words are the vocabulary from then on."""
        return self._with_counts(bayes.fit_counts(corpus))

    def train_more(self, rows: DataFrame) -> BayesModel:
        """Go on with further rows: as if they had been there at the fit, with its vocabulary."""
        return self._with_counts(written(bayes.continue_counts(self.counts, _text_label(rows)), "nb-counts"))

    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        scores = bayes.joint_scores(rows, self.weights, list(keep), TEXT)
        return bayes.predict_proba(bayes.predict(scores))

    def save(self, path: str) -> None:
        sinks.write_table(self.counts, path)

    def load(self, spark: SparkSession, path: str) -> BayesModel:
        counts = ", ".join(f"{label} BIGINT" for label in LABELS)
        return self._with_counts(sinks.read_table(spark, path, f"token STRING, {counts}"))


class LexiconModel(TextModel):
    """Rule-based polarity over a table of words, which is required; nothing to train."""

    def __init__(
        self,
        words: DataFrame | None = None,
        modifiers: DataFrame | None = None,
        threshold: float = 0.05,
    ) -> None:
        self.words, self.modifiers, self.threshold = words, modifiers, threshold

    def train(self, rows: DataFrame, general: DataFrame | None = None) -> LexiconModel:
        return self

    def score(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        if self.words is None:
            raise ValueError("the lexicon model needs a table of words: token, valence")
        return lexicon.polarity(rows, self.words, list(keep), TEXT, self.modifiers)

    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        t = self.threshold
        scored = lexicon.predict(self.score(rows, keep), t, -t)
        return lexicon.predict_proba(scored, t, -t).drop("compound")

    def save(self, path: str) -> None:
        """Words, modifiers and threshold: all that decides a prediction."""
        spark = SparkSession.active()
        if self.words is None:
            raise ValueError("the lexicon model has no table of words to save")
        changes = self.modifiers if self.modifiers is not None else lexicon.modifiers(spark)
        sinks.write_table(self.words.select("token", "valence"), f"{path}/words")
        sinks.write_table(changes.select("token", "degree", "negates"), f"{path}/modifiers")
        row = spark.createDataFrame([(self.threshold,)], "threshold double")
        sinks.write_table(row, f"{path}/threshold")

    def load(self, spark: SparkSession, path: str) -> LexiconModel:
        self.words = sinks.read_table(spark, f"{path}/words", "token STRING, valence DOUBLE")
        self.modifiers = sinks.read_table(
            spark, f"{path}/modifiers", "token STRING, degree DOUBLE, negates BOOLEAN"
        )
        self.threshold = sinks.read_table(spark, f"{path}/threshold", "threshold DOUBLE").first()[0]
        return self


class LearnedModel(TextModel):
    """Logistic regression on hashed words."""

    def __init__(self, features: int = 1 << 16, max_iter: int = 20) -> None:
        self.features, self.max_iter = features, max_iter
        self.model: PipelineModel | None = None

    def train(self, rows: DataFrame, general: DataFrame | None = None) -> LearnedModel:
        self.model = learned.fit(_text_label(rows), general, self.features, self.max_iter)
        return self

    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        return learned.predict(rows, self.model, list(keep), TEXT)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, spark: SparkSession, path: str) -> LearnedModel:
        self.model = PipelineModel.load(path)
        return self


class StagedModel(TextModel):
    """Logistic regression fitted on a general corpus, then on specific rows starting there."""

    def __init__(self, features: int = 1 << 16, max_iter: int = 20, pull: float = staged.PULL) -> None:
        self.features, self.max_iter, self.pull = features, max_iter, pull
        self.model: staged.Regression | None = None

    def train(self, rows: DataFrame, general: DataFrame | None = None) -> StagedModel:
        if general is not None:
            self.model = staged.fit(general, None, self.features, self.max_iter)
        self.model = staged.fit(_text_label(rows), self.model, self.features, self.max_iter, self.pull)
        return self

    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        return staged.predict(rows, self.model, list(keep), TEXT)

    def save(self, path: str) -> None:
        sinks.write_table(staged.as_table(SparkSession.active(), self.model), path)

    def load(self, spark: SparkSession, path: str) -> StagedModel:
        self.model = staged.from_table(sinks.read_table(spark, path))
        return self


class BlendModel(TextModel):
    """A learned member and the lexicon, weighted; both are tuned on held-out rows."""

    def __init__(self, member: TextModel | None = None, words: LexiconModel | None = None) -> None:
        self.member = member or LearnedModel()
        self.words = words or LexiconModel()
        self.threshold, self.weight = blend.DEFAULT_THRESHOLD, blend.DEFAULT_WEIGHT

    def train(self, rows: DataFrame, general: DataFrame | None = None) -> BlendModel:
        quality.require_rows(rows, quality.MIN_ROWS_BLEND, "blend training rows")
        parts = split.hash_split(rows, [ID], seed=1)
        self.member.train(parts.filter("NOT is_test"), general)
        members = self._members(parts.filter("is_test"), (ID, LABEL))
        best = blend.blend_best(blend.blend_grid(members, LABEL)).first()
        self.threshold, self.weight = best["pos_thresh"], best["weight"]
        return self

    def _members(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        shares = self.member.predict_proba(rows, keep).drop("prediction")
        return shares.join(self.words.score(rows, (ID,)), ID)

    def predict_proba(self, rows: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        blended = blend.blend_predict(self._members(rows, keep), self.threshold, self.weight)
        return blended.select(*keep, *LABELS, "prediction")

    def save(self, path: str) -> None:
        self.member.save(f"{path}/member")
        self.words.save(f"{path}/lexicon")
        row = [(self.threshold, self.weight)]
        spark = SparkSession.active()
        sinks.write_blend(
            spark.createDataFrame(row, "pos_thresh double, weight double"), f"{path}/parameters"
        )

    def load(self, spark: SparkSession, path: str) -> BlendModel:
        self.member.load(spark, f"{path}/member")
        self.words.load(spark, f"{path}/lexicon")
        self.threshold, self.weight = sinks.read_blend(spark, f"{path}/parameters")
        return self


# Fixed names of the model types. The two transformer names give the learned
# models that stand in for them: the one trained in two stages, and the plain one.
MODELS = {
    "naive_bayes": BayesModel,
    "bert": StagedModel,
    "vader": LexiconModel,
    "ensemble": BlendModel,
    "financial_bert": LearnedModel,
}


def get_model(name: str, **options) -> TextModel:
    try:
        return MODELS[name](**options)
    except KeyError:
        raise ValueError(f"unknown model type: {name}; one of {sorted(MODELS)}") from None
