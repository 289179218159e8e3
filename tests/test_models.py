from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketmood.functions.labels import LABELS
from marketmood.functions.words import DAMPENERS, DEGREE, INTENSIFIERS, NEGATORS, SEED_VALENCES
from marketmood.operators import bayes, blend, lexicon
from marketmood import storage
from marketmood.plans.models import MODELS, BlendModel, LearnedModel, LexiconModel, get_model

GENERAL = [
    ("Profit rose, great profit", "bullish"), ("strong growth and profit", "bullish"),
    ("loss widened on weak sales", "bearish"), ("fraud and loss", "bearish"),
    ("the company met on monday", "neutral"),
]
SPECIFIC = [
    ("profit beat unseenword", "bullish"), ("weak loss again", "bearish"), ("monday report", "neutral"),
    ("growth growth", "bullish"), ("sales met", "neutral"),
]


def words(text):
    return re.findall(r"\w\w+", text.lower())


def plain_bayes(specific, general):
    vocab = {w for t, _ in general for w in words(t)}
    counts, docs = defaultdict(Counter), Counter()
    for text, label in general + specific:
        docs[label] += 1
        counts[label].update(w for w in words(text) if w in vocab)
    n = sum(docs.values())
    prior = {c: math.log(docs[c] / n) for c in docs}
    like = {
        c: {w: math.log(counts[c][w] + 1) - math.log(sum(counts[c].values()) + len(vocab)) for w in vocab}
        for c in docs
    }
    return vocab, prior, like


def test_bayes_matches_plain_python(spark):
    schema = "text string, label string"
    general, specific = spark.createDataFrame(GENERAL, schema), spark.createDataFrame(SPECIFIC, schema)
    vocab, prior, like = plain_bayes(SPECIFIC, GENERAL)
    model = {r["token"]: r for r in bayes.fit(specific, general).collect()}
    assert set(model) == vocab | {""}
    for c in LABELS:
        assert model[""][f"w_{c}"] == pytest.approx(prior[c])
        for w in vocab:
            assert model[w][f"w_{c}"] == pytest.approx(like[c][w])
    docs = ["profit profit loss", "nothing known", "", "growth on monday"]
    rows = spark.createDataFrame(list(enumerate(docs)), "news_id int, cleaned_text string")
    scores = bayes.joint_scores(rows, bayes.fit(specific, general), ["news_id"], "cleaned_text")
    said = {r["news_id"]: r for r in bayes.predict_proba(bayes.predict(scores)).collect()}
    assert len(said) == len(docs)
    for i, text in enumerate(docs):
        joint = {c: prior[c] + sum(like[c][w] for w in words(text) if w in vocab) for c in LABELS}
        best = max(sorted(LABELS), key=lambda c: round(joint[c], 9))
        assert said[i]["prediction"] == best
        total = sum(math.exp(v) for v in joint.values())
        for c in LABELS:
            assert said[i][c] == pytest.approx(math.exp(joint[c]) / total)


def test_label_absent_from_training_has_probability_zero(spark):
    rows = spark.createDataFrame(SPECIFIC[:2], "text string, label string")
    model = bayes.fit(rows)
    docs = spark.createDataFrame([(1, "profit")], "news_id int, cleaned_text string")
    said = bayes.predict_proba(
        bayes.predict(bayes.joint_scores(docs, model, ["news_id"], "cleaned_text"))
    ).first()
    assert said["neutral"] == 0.0 and said["prediction"] == "bullish"


def test_beyond_the_broadcast_limit_results_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_bayes_matches_plain_python(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tfidf_bayes_matches_plain_python(spark):
    train = GENERAL + SPECIFIC
    tests = ["profit growth", "unheard words", "weak monday loss loss"]
    n = len(train)
    df = Counter(w for t, _ in train for w in set(words(t)))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def vector(text):
        raw = {w: c * idf[w] for w, c in Counter(words(text)).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / norm for w, x in raw.items()}

    sums, docs = defaultdict(Counter), Counter()
    for text, label in train:
        docs[label] += 1
        for w, x in vector(text).items():
            sums[label][w] += x
    rows = spark.createDataFrame(
        [(i, t, l) for i, (t, l) in enumerate(train)], "doc_id int, text string, label string"
    )
    model = bayes.fit_tfidf(rows)
    asked = spark.createDataFrame(list(enumerate(tests)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in bayes.joint_scores_tfidf(asked, model, ["doc_id"], "text").collect()}
    for i, text in enumerate(tests):
        for c in LABELS:
            total = sum(sums[c].values()) + len(idf)
            want = math.log(docs[c] / n) + sum(
                x * (math.log(sums[c][w] + 1) - math.log(total)) for w, x in vector(text).items()
            )
            assert got[i][c] == pytest.approx(want)


def plain_polarity(text, lex):
    boost = {w: DEGREE for w in INTENSIFIERS} | {w: -DEGREE for w in DAMPENERS}
    tokens = [w for w in text.split() if len(w) > 1]
    total = 0.0
    for i, word in enumerate(tokens):
        if word not in lex or word in boost:
            continue
        v = lex[word]
        for k, damp in enumerate((1.0, 0.95, 0.9)):
            if i > k and tokens[i - k - 1] not in lex:
                before = tokens[i - k - 1]
                s = boost.get(before, 0.0)
                v += (-s if v < 0 else s) * damp
                if before in NEGATORS:
                    v *= -0.74
        total += v
    return max(-1.0, min(1.0, round(total / math.sqrt(total * total + 15), 4)))


def test_polarity_matches_plain_python(spark):
    lex = dict(SEED_VALENCES) | {"hugely": 0.5, "despite": -0.3}
    texts = [
        "good", "extremely good", "really extremely good profit", "dont good", "never really bad loss",
        "slightly weak x growth", "despite good", "hugely great", "without hugely a bad year", "",
        "nothing known here", "dont think extremely great gain", "bad bad bad fraud crisis loss weak",
        "cant dont good", "almost x y bad", "good despite loss",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "news_id int, cleaned_text string")
    table = spark.createDataFrame(list(lex.items()), "token string, valence double")
    got = {r["news_id"]: r["compound"] for r in lexicon.polarity(rows, table, ["news_id"]).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_polarity(text, lex), abs=1e-4), text
    assert got[texts.index("good")] == pytest.approx(round(1.9 / math.sqrt(1.9**2 + 15), 4))


def test_grid_matches_single_settings(spark):
    rows = spark.range(60).select(
        F.col("id").alias("news_id"),
        ((F.col("id") * 7 % 10) / 10.0).alias("bullish"),
        ((F.col("id") * 7 % 10) / -20.0 + 0.5).alias("neutral"),
        ((F.col("id") * 7 % 10) / -20.0 + 0.5).alias("bearish"),
        ((F.col("id") * 13 % 41) / 20.0 - 1.0).alias("compound"),
        F.element_at(F.array(*[F.lit(l) for l in LABELS]), (F.col("id") * 5 % 3 + 1).cast("int")).alias("label"),
    )
    grid = {(r["pos_thresh"], r["weight"]): r["accuracy"] for r in blend.blend_grid(rows).collect()}
    assert len(grid) == 35
    for (t, w), accuracy in list(grid.items())[::6]:
        said = blend.blend_predict(rows, t, w)
        assert said.filter("prediction = label").count() / 60 == pytest.approx(accuracy)
    best = blend.blend_best(blend.blend_grid(rows)).first()
    top = max(grid.values())
    assert (best["pos_thresh"], best["weight"]) == min(k for k, a in grid.items() if a == top)
    wrong = blend.blend_best(blend.blend_grid(rows.withColumn("label", F.lit("other")))).first()
    assert (wrong["pos_thresh"], wrong["weight"]) == (0.05, 0.7)


def labelled(spark, n=60):
    base = SPECIFIC + GENERAL
    rows = [(i, *base[i % len(base)]) for i in range(n)]
    return spark.createDataFrame(rows, "news_id long, cleaned_text string, sentiment string")


@pytest.mark.parametrize("name", sorted(MODELS))
def test_every_model_trains_predicts_saves_and_loads(spark, tmp_path, name):
    rows = labelled(spark)
    general = spark.createDataFrame(GENERAL, "text string, label string")
    small = {"features": 1 << 10, "max_iter": 10}
    options = small if name in ("bert", "financial_bert") else {}
    if name == "ensemble":
        options = {"member": LearnedModel(**small), "words": LexiconModel(lexicon.seed_lexicon(spark))}
    if name == "vader":
        options = {"words": lexicon.seed_lexicon(spark).withColumn("valence", F.col("valence") * 2), "threshold": 0.2}
    model = get_model(name, **options).train(rows, general)
    said = model.predict_proba(rows)
    assert said.count() == rows.count()
    assert said.filter(F.abs(F.col("bullish") + F.col("neutral") + F.col("bearish") - 1) > 1e-6).count() == 0
    metrics = model.evaluate(rows, str(tmp_path / "m")).first()
    assert 0.0 <= metrics["accuracy"] <= 1.0
    if name in ("naive_bayes", "bert"):
        assert metrics["accuracy"] > 0.9
    assert spark.read.json(str(tmp_path / "m" / "metrics")).count() == 1
    assert spark.read.parquet(str(tmp_path / "m" / "confusion_matrix")).count() == 3
    model.save(str(tmp_path / "model"))
    # Nothing but the saved state may decide what the loaded model says.
    bare = options if name in ("bert", "financial_bert") else {}
    again = get_model(name, **bare).load(spark, str(tmp_path / "model"))
    assert model.predict(rows).exceptAll(again.predict(rows)).count() == 0


def test_registry_and_minimum(spark):
    with pytest.raises(ValueError):
        get_model("oracle")
    with pytest.raises(ValueError):
        BlendModel().train(labelled(spark, 19))
