import math

import pytest
from pyspark.sql import functions as F

from colloquy.functions.constants import LABELS
from colloquy.operators import evaluate, messages, models

OWN = {"joy": "glad bright laugh", "fear": "dark scared shake", "anger": "shout furious slam"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"i feel {words.split()[i % 3]} {words.split()[(i + 1) % 3]} today", label)
            for i, (label, words) in enumerate(list(OWN.items()) * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def fitted(corpus):
    return models.fit_models(corpus, max_iter=10)


def test_tfidf_weights_follow_the_smoothed_formula(spark):
    df = spark.createDataFrame([(0, "aa bb", "x"), (1, "aa bb", "y"), (2, "aa cc", "x")], "doc_id long, text string, label string")
    terms = models.with_terms(df)
    counts = models.fit_counts(terms)
    product, unit = models.fit_weights(counts.transform(terms))
    row = unit.transform(product.transform(counts.transform(terms))).where("doc_id = 0").first()
    got = dict(zip((counts.vocabulary[i] for i in row.features.indices), row.features.values))
    raw = {"aa": math.log(4 / 4) + 1, "bb": math.log(4 / 3) + 1, "aa bb": math.log(4 / 3) + 1}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({t: v / norm for t, v in raw.items()})


@pytest.mark.parametrize("name", models.MODELS)
def test_models_learn_and_score(fitted, corpus, name):
    rows = models.predict(fitted[name], corpus).collect()
    assert all(r.pred == r.label for r in rows)
    assert all(0.0 < r.confidence <= 1.0 for r in rows)


def test_short_and_long_inputs(fitted, spark):
    df = spark.createDataFrame([(0, "sad", "joy"), (1, "i feel dark and scared " * 200, "fear"), (2, "", "joy")],
                               "doc_id long, text string, label string")
    got = {r.doc_id: r for r in models.predict(fitted[models.SVM], df).collect()}
    assert all(r.pred in OWN for r in got.values()) and got[1].pred == "fear"


def test_save_and_load(fitted, corpus, tmp_path):
    path = str(tmp_path / "model")
    models.save(fitted[models.SVM], path)
    again = models.predict(models.load(path), corpus).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in models.predict(fitted[models.SVM], corpus).collect()]


def test_cross_validation(corpus):
    metrics = models.cross_validate(corpus, [models.BAYES], folds=3)
    assert metrics.count() == 3
    summary = evaluate.cv_summary(metrics)
    assert summary.where("metric = 'accuracy'").first()["mean"] == 1.0
    assert models.best_name(summary) == models.BAYES


def test_scorer_plugs_into_the_policy(fitted, spark):
    df = spark.createDataFrame([(1, "s", "it is dark and i shake"), (2, "s", "I want to die")],
                               "message_id long, session_id string, message string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.message_id: r for r in messages.score_messages(df, models.scorer(fitted[models.BAYES])).collect()}
    assert got[1].emotion == "fear" and got[2].emotion == "neutral" and set(OWN) < set(LABELS)
