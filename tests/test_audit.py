import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import audit as A
from colloquy.operators import frames


def corpus(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def small(spark):
    return corpus(spark, [
        ("I am happy!", "joy"), ("I am happy!", "joy"), ("i am HAPPY", "fear"), ("why me?", "sadness"),
        (None, "joy"), ("  ", None), ("ok", "odd"), ("one two three four", "joy"),
    ])


def test_missing_and_blank(small):
    got = {r.column_name: (r.rows, r.missing, r.blank) for r in A.missing_and_blank(small, ["text", "label"]).collect()}
    assert got == {"text": (8, 1, 1), "label": (8, 1, 0)}


def test_duplicates(small):
    got = {r.kind: (r.groups, r.repeats, r.rows_sharing) for r in A.duplicate_counts(small, ["text", "label"]).collect()}
    assert got["row"] == (7, 1, 2) and got["text"] == (7, 1, 2) and got["normalized"] == (6, 2, 3)


def test_conflicts(small):
    assert [r.n_labels for r in A.label_conflicts(small).collect()] == [2]
    assert [r.doc_id for r in A.conflict_examples(small).collect()] == [0, 1, 2]


def test_label_sets(small):
    got = {tuple(r) for r in A.label_set_diff(small).collect()}
    assert ("unexpected", "odd") in got and ("missing", "neutral") in got and len(got) == 5


def test_validation_gate(small, spark):
    report = A.validate_corpus(small, ["text", "label"]).first()
    assert not report.passed and report.conflicting_texts == 1 and report.missing_or_blank_rows == 2
    with pytest.raises(ValueError):
        A.require_valid(A.validate_corpus(small, ["text", "label"]))
    labels = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
    clean = corpus(spark, [(f"text {x}", x) for x in labels] + [("text joy", "joy")])
    assert A.require_valid(A.validate_corpus(clean, ["text", "label"]))["exact_duplicate_rows"] == 1


def test_describe_matches_numpy(spark):
    values = [float(v) for v in (np.random.default_rng(3).integers(0, 50, 300))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = frames.describe(df, [], ["v"]).first()
    want = [len(values), np.mean(values), statistics.stdev(values), min(values), *np.percentile(values, [25, 50, 75]), max(values)]
    assert list(row)[1:] == pytest.approx(want, abs=1e-4)


def test_describe_single_value_has_no_deviation(spark):
    assert frames.describe(spark.createDataFrame([(2.0,)], "v double"), [], ["v"]).first()["std"] is None


def test_histogram(spark):
    values = [0.0, 1.0, 1.0, 2.5, 9.9, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.n for r in frames.histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == np.histogram(values, 5)[0].tolist()
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r.n for r in frames.histogram(same, "v", 4).orderBy("bin").collect()] == np.histogram([3.0] * 4, 4)[0].tolist()


def test_vocabulary(small):
    row = A.vocab_stats(small).first()
    assert (row.vocab_size, row.total_tokens, row.rare_words) == (10, 16, 7)
    assert A.top_tokens(small, 2).collect()[0].token == "am"
    assert A.vocab_stats(small, approximate=True).first().total_tokens == 16


def test_length_outliers(small):
    row = A.length_outliers(small).first()
    assert (row.short_rows, row.noisy_rows) == (6, 2) and row.long_rows == 1


def test_box_whiskers(spark):
    df = corpus(spark, [(" ".join(["w"] * n), "x") for n in (1, 2, 2, 3, 3, 4, 30)])
    row = A.box_stats(df).first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.n_outliers) == (2.0, 3.0, 3.5, 1.0, 4.0, 1)


def test_empty_corpus(small):
    none = small.where("false")
    assert A.vocab_stats(none).first().vocab_size == 0
    assert A.duplicate_counts(none, ["text"]).count() == 0
    assert A.validate_corpus(none, ["text", "label"]).first().rows == 0
    assert A.class_distribution(none).count() == 0
    assert A.punct_share(none).first().rows == 0
    assert sum(r.n for r in frames.histogram(none.select(F.length("text").alias("v")), "v", 3).collect()) == 0
