"""Keyed linear models: closed form, descent against plain loops, accuracy beside MLlib, folds against separate fits."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import evaluate, linear, messages, models, tiles
from colloquy.session import shared_dir
from colloquy.sources import derived as D

ROWS = [(0, "sun sun day", "a"), (1, "sun day off", "a"), (2, "rain day", "b"), (3, "rain off", "b"), (4, None, "b"), (5, "rain", None)]
OWN = {"joy": "glad bright laugh", "fear": "dark scared shake", "anger": "shout furious slam"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"i feel {words.split()[i % 3]} {words.split()[(i + 1) % 3]} today", label)
            for i, (label, words) in enumerate(list(OWN.items()) * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def test_bayes_closed_form(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, label string").withColumns({"row": F.lit(1), "terms": F.lit("x")})
    model = linear.fit(df)
    weights = {r.term: r.w for r in model.terms.collect()}
    assert model.labels == ("a", "b") and set(weights) == {"sun", "day", "off", "rain", "sun day"}
    n, df_of = 5, {"sun": 2, "day": 3, "off": 2, "rain": 2, "sun day": 2}
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df_of.items()}

    def unit(counts):
        raw = {t: c * idf[t] for t, c in counts.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / size for t, x in raw.items()}

    first, second = unit({"sun": 2, "day": 1, "sun day": 1}), unit({"sun": 1, "day": 1, "off": 1, "sun day": 1})
    mass = math.log(sum(first.values()) + sum(second.values()) + 5)
    assert weights["sun"][0] == pytest.approx(math.log1p(first["sun"] + second["sun"]) - mass)
    got = {r.doc_id: r for r in linear.predict(model, df).collect()}
    assert [got[i].pred for i in range(4)] == ["a", "a", "b", "b"] and len(got) == 6
    assert got[4].pred == "b" and got[4].confidence == pytest.approx(3 / 5)


def _vectors(rows):
    """Terms and unit TF-IDF vectors of labelled rows, by plain loops."""
    docs = []
    for _, text, _ in rows:
        w = [x for x in text.split() if len(x) > 1]
        docs.append(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
    terms = sorted(t for t in set().union(*docs) if sum(t in d for d in docs) >= 2)
    raw = np.array([[d.count(t) * (math.log((1 + len(docs)) / (1 + sum(t in e for e in docs))) + 1) for t in terms] for d in docs])
    return terms, raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)


def _descend(x, y, k, kind, steps):
    n = len(x)
    rho = max(x @ x.mean(0))
    bend = 1.0 if kind == models.LOGREG else 4.0
    step, bias_step = 1 / (bend * rho + 1 / n), 1 / (bend + 1 / n)
    w = v = np.zeros((x.shape[1], k))
    b = a = np.zeros(k)
    target = np.eye(k)[y]
    for t in range(steps):
        z = x @ v + a
        if kind == models.LOGREG:
            e = np.exp(z - z.max(1, keepdims=True))
            c, penal = e / e.sum(1, keepdims=True) - target, 0.0
        else:
            side = 2 * target - 1
            c, penal = -2 * side * np.maximum(0, 1 - side * z), 1 / n
        nw, nb = v - step * (v / n + x.T @ c / n), a - bias_step * (penal * a + c.mean(0))
        v, a, w, b = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b), nw, nb
    return w, b


@pytest.mark.parametrize("kind", [models.LOGREG, models.SVM])
def test_descent_equals_plain_loops(corpus, kind):
    rows = [tuple(r) for r in corpus.collect()]
    terms, x = _vectors(rows)
    labels = sorted(OWN)
    w, b = _descend(x, np.array([labels.index(r[2]) for r in rows]), 3, kind, 4)
    model = linear.fit(corpus, kind, steps=4)
    got = {r.term: r.w for r in model.terms.collect()}
    assert sorted(got) == terms and model.labels == tuple(labels)
    assert np.allclose([got[t] for t in terms], w) and np.allclose(model.bias, b)


@pytest.mark.parametrize("name", [models.SVM])
def test_as_good_as_the_optimizer(spark, name):
    """On real texts, beside MLlib's fit of the same family until it converges."""
    rows = D.corpus_clean(spark, "/root/testdata/sf0.001")
    train, held = rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0")
    own = linear.predict(linear.fit(train, name, steps=12), held)
    other = models.predict(models.fit_models(train, [name], max_iter=10)[name], held)
    a, b = (evaluate.overall_metrics(x).first().accuracy for x in (own, other))
    assert a >= b - 0.03 and a > 0.9


def test_folds_equal_separate_fits(corpus):
    """The other two models are held against SQL, fold by fold, in the query tests."""
    rows = corpus.withColumn("text", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 4 == 0, "glad scared").otherwise("slam")))
    got = {r.row: r.pred for r in linear.cross_predict(rows, [models.BAYES], folds=2).collect()}
    dealt = linear.split.stratified_folds(rows, folds=2)
    for fold in range(2):
        fitted = linear.fit(dealt.where(F.col("fold") != fold))
        for row in linear.predict(fitted, dealt.where(F.col("fold") == fold)).collect():
            assert got[row.doc_id] == row.pred
    assert len(got) == 90


def test_cross_validation_and_choice(corpus):
    summary = evaluate.cv_summary(linear.cross_validate(corpus, [models.BAYES], folds=3))
    assert summary.where("metric = 'accuracy'").first()["mean"] == 1.0 and models.best_name(summary) == models.BAYES


def test_short_long_and_repeated_inputs(corpus, spark):
    model = linear.fit(corpus, models.SVM, steps=3)
    df = spark.createDataFrame([(0, "sad", "joy"), (1, "i feel dark and scared " * 20_000, "fear"), (2, "", None), (3, None, "joy"), (None, "dark", "x")],
                               "doc_id long, text string, pred string")
    got = linear.predict(model, df).collect()
    assert len(got) == 5 and all(r.pred in OWN and 0 < r.confidence <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 1).pred == "fear"


def test_nothing_to_learn_from(corpus):
    empty = corpus.limit(0)
    for name in models.MODELS:
        rows = linear.predict(linear.fit(empty, name, steps=1), corpus).collect()
        assert len(rows) == 90 and {r.pred for r in rows} == {None}
    model = linear.fit(corpus.withColumn("text", F.lit(None).cast("string")), models.LOGREG, steps=1)
    assert linear.predict(model, corpus).count() == 90
    with pytest.raises(ValueError):
        linear.fit(corpus, "unknown")


def test_term_counts_stay_in_the_row(spark):
    df = spark.createDataFrame([(1, "bb aa bb a AA bb"), (2, None), (3, "x")], "doc_id long, text string")
    counted = linear.term_counts(df, "text", F.col("doc_id"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: {t.term: t.tf for t in r.terms} for r in counted.collect()}
    assert got == {1: {"aa": 2, "bb": 3, "bb aa": 2, "aa bb": 2}, 2: {}, 3: {}}


def test_scorer_plugs_into_the_policy(corpus, spark):
    df = spark.createDataFrame([(1, "s", "it is dark and i shake"), (2, "s", "I want to die")],
                               "message_id long, session_id string, message string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.message_id: r for r in messages.score_messages(df, linear.scorer(linear.fit(corpus))).collect()}
    assert got[1].emotion == "fear" and got[2].emotion == "neutral"


def test_blocks_hold_the_terms_of_each_row(spark):
    """Counted in blocks and by part as within the row; a row that comes twice keeps the terms of both."""
    rows = [(i // 2 if i < 4 else i, f"aa b{i % 3}b aa B{i % 3}b cc" if i % 5 else None, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").withColumn("fold", F.lit(-1))
    found = tiles.counted(df.repartition(3), "text", "doc_id", "label", "fold", 3).collect()
    ids = {r.block: r.rows for r in found if r.rows is not None}
    got = Counter()
    for r in found:
        places, tf, done = np.frombuffer(r["at"] or b"", np.uint16), np.frombuffer(r["tf"] or b"", np.int32), 0
        for term, n in zip(r.terms or [], np.frombuffer(r["counts"] or b"", np.int32)):
            for at, count in zip(places[done:done + n], tf[done:done + n]):
                got[ids[r.block][at], term] += int(count)
            done += n
    want = Counter()
    for r in linear.term_counts(df, "text", F.col("doc_id")).collect():
        for t in r.terms:
            want[r.doc_id, t.term] += t.tf
    assert got == want and sorted(x for v in ids.values() for x in v) == sorted({r[0] for r in rows})
    terms = spark.createDataFrame([(r.term,) for r in linear.term_counts(df, "text").select(F.inline("terms")).distinct().collect()], "term string")
    dealt = {r.term: r.p for r in terms.select("term", tiles.part("term", 3).alias("p")).collect()}
    assert all(dealt[t] == r.part for r in found for t in r.terms or [])


def test_steps_write_rows_and_not_weights(corpus, spark):
    """What a step keeps grows with rows and labels; shuffles of earlier steps are gone."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in files.getAllFiles().mkString("|").split("|") if "/shuffle_" in x}

    before, folder = shuffles(), Path(shared_dir(spark))
    known = set(folder.iterdir())
    linear.fit(corpus, models.SVM, steps=6)
    new = [p for p in folder.iterdir() if p not in known]
    assert not [p for p in new if p.name.startswith(("weights", "pulls", "unit-vectors"))]
    steps = [sum(f.stat().st_size for f in p.glob("*.parquet")) for p in new if p.name.startswith("steps")]
    assert len(steps) == 6 and max(steps) < 40_000
    assert len(shuffles() - before) <= 30


def test_products_by_runs_of_entries(monkeypatch):
    rng = np.random.default_rng(7)
    values, taken, to = rng.random((5, 3)), rng.integers(0, 5, 40), rng.integers(0, 4, 40)
    tf = rng.integers(1, 4, 40).astype(float)
    want = np.zeros((6, 3))
    np.add.at(want, to, values[taken] * tf[:, None])
    for size in (7, 40, 1000):
        monkeypatch.setattr(tiles, "ENTRIES", size)
        assert np.allclose(tiles._product(values, taken, tf, to, 6), want)
    assert tiles._product(values, taken[:0], tf[:0], to[:0], 6).shape == (6, 3)


def test_models_in_steps_share_their_passes(corpus, monkeypatch):
    """A pass over the tiles for each step, whatever the number of models; the same predictions as one model at a time."""
    passes, margins = [], tiles.margins
    monkeypatch.setattr(tiles, "margins", lambda *a, **k: passes.append(a) or margins(*a, **k))
    together = {(r.model, r.row): r.pred for r in linear.cross_predict(corpus, folds=3, steps=3).collect()}
    assert len(passes) == 1 + 3 + 2  # curvature, steps, what is judged: both models in steps, and Bayes
    alone = {(r.model, r.row): r.pred for name in models.MODELS for r in linear.cross_predict(corpus, [name], folds=3, steps=3).collect()}
    assert together == alone and len(together) == 3 * corpus.count()
    both, one = linear.fit_models(corpus, steps=2), linear.fit(corpus, models.SVM, steps=2)
    weights = {r.term: r.w for r in one.terms.collect()}
    assert {r.term: r.w for r in both[models.SVM].terms.collect()} == {t: pytest.approx(w) for t, w in weights.items()}
    assert both[models.SVM].bias == pytest.approx(one.bias)


def test_passes_in_bounded_room(corpus, spark, monkeypatch):
    """Cells that do not fit go one after the other, with the same weights; rows send numbers to groups of parts, not to each part."""
    whole = linear.fit(corpus, models.SVM, steps=2)
    monkeypatch.setattr(tiles, "ROOM", corpus.count() * 8 * 2)
    folder = Path(shared_dir(spark))
    known = set(folder.iterdir())
    some = linear.fit(corpus, models.SVM, steps=2)
    assert [p for p in folder.iterdir() if p not in known and p.name.startswith("margins")]
    weights = {r.term: r.w for r in whole.terms.collect()}
    assert {r.term: r.w for r in some.terms.collect()} == {t: pytest.approx(w) for t, w in weights.items()}
    tiled = some.sums.tiled
    assert tiles.Tiled(tiled.frame, 6400, (1,), 1, 2).groups <= 6400 / tiles.GROUP
    assert tiles.Tiled(tiled.frame, 2, (1,), 1, 2).groups == 2


def test_a_fit_keeps_only_what_is_read_again(corpus, spark):
    """Counts are not stored, and neither are the states of earlier steps."""
    folder = Path(shared_dir(spark))
    known = set(folder.iterdir())
    linear.cross_predict(corpus, [models.SVM], folds=2, steps=3).count()
    new = {p.name: list(p.glob("*.parquet")) for p in folder.iterdir() if p not in known}
    assert not [n for n in new if n.startswith("term-counts")]
    assert len([n for n, files in new.items() if n.startswith("steps") and files]) == 1


def test_just_fitted_and_stored_models_score_alike(corpus, spark):
    df = corpus.unionByName(spark.createDataFrame([(900, None, "x"), (901, "unknown words", "x"), (902, "dark dark laugh", "x"), (902, "slam", "x"), (None, "dark", "x")], corpus.schema))
    for name in (models.BAYES, models.LOGREG):
        model = linear.fit(corpus, name, steps=2)
        own, other = ([(r.doc_id, r.text, r.pred, r.confidence) for r in linear.predict(m, df).collect()]
                      for m in (model, linear.LinearModel(model.terms, model.labels, model.bias)))
        key = lambda r: (r[0] is None, r[0], r[1] or "")
        for a, b in zip(sorted(own, key=key), sorted(other, key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_places_beyond_small_numbers():
    """Rows past 2**16 and counts past 255 keep their values."""
    high, tf = np.array([0, 3, 255]), np.array([1, 70_000])
    assert list(tiles._widened(tiles._narrow(high, np.uint8, np.uint16), 3, np.uint8, np.uint16)) == [0, 3, 255]
    assert list(tiles._widened(tiles._narrow(high + 1, np.uint8, np.uint16), 3, np.uint8, np.uint16)) == [1, 4, 256]
    assert list(tiles._widened(tiles._narrow(tf, np.uint8, np.int32), 2, np.uint8, np.int32)) == [1, 70_000]


@pytest.mark.parametrize("kind", [models.LOGREG, models.SVM])
def test_fits_until_the_gradient_is_gone(corpus, kind):
    """Unless steps are asked for, the fit ends at the minimum."""
    rows = [tuple(r) for r in corpus.collect()]
    terms, x = _vectors(rows)
    labels = sorted(OWN)
    target = np.eye(3)[[labels.index(r[2]) for r in rows]]

    def gradient(w, b):
        z = x @ w + b
        if kind == models.LOGREG:
            e = np.exp(z - z.max(1, keepdims=True))
            c, own = e / e.sum(1, keepdims=True) - target, 0.0
        else:
            side = 2 * target - 1
            c, own = -2 * side * np.maximum(0, 1 - side * z), b
        return math.sqrt(((w + x.T @ c) ** 2).sum() + ((c.sum(0) + own) ** 2).sum())

    model = linear.fit(corpus, kind)
    got = {r.term: r.w for r in model.terms.collect()}
    at_zero = gradient(np.zeros((len(terms), 3)), np.zeros(3))
    assert gradient(np.array([got[t] for t in terms]), np.array(model.bias)) <= 2e-4 * at_zero
