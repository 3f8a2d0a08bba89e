import pytest
from pyspark.sql import functions as F

from colloquy.operators import linear, models, similarity
from colloquy.session import scratch_path
from colloquy.sources import artifacts as A

BANK = ["i feel glad and warm", "it is dark and i shake", "glad warm day", "dark night shake", "rain and rain"]


@pytest.fixture
def bank(spark):
    rows = [(i, t, "joy" if i % 2 == 0 else "fear") for i, t in enumerate(BANK)]
    return spark.createDataFrame(rows, "bank_pos long, text string, label string")


def test_saved_tables_route_like_the_fitted_ones(spark, bank):
    path = scratch_path(spark, "artifact")
    model, index = linear.fit(bank, models.BAYES, row_id="bank_pos"), similarity.tfidf_index(bank)
    A.publish(spark, path, {**A.model_tables(model), **A.index_tables(index)})
    tables = A.load(spark, path)
    again = A.model_of(tables)
    assert again.labels == model.labels and again.bias == model.bias
    asked = bank.select(F.col("bank_pos").alias("query_id"), "text")
    first, second = linear.predict(model, asked, "query_id"), linear.predict(again, asked, "query_id")
    assert sorted(first.collect()) == sorted(second.collect())
    fresh = similarity.tfidf_best(asked, bank).collect()
    assert sorted(similarity.tfidf_best(asked, bank, A.index_of(tables)).collect()) == sorted(fresh)


def test_versions_and_tags(spark, bank):
    path = scratch_path(spark, "artifact")
    with pytest.raises(LookupError):
        A.load(spark, path)
    assert A.publish(spark, path, {"a": bank}, "x") == 1
    assert A.publish(spark, path, {"a": bank.limit(0)}, "y") == 2
    assert A.load(spark, path)["a"].count() == 0
    assert A.load(spark, path, version=1)["a"].count() == A.load(spark, path, tag="x")["a"].count() == 5
    with pytest.raises(LookupError):
        A.load(spark, path, version=3)


def test_a_writer_that_dies_changes_nothing(spark, bank):
    path = scratch_path(spark, "artifact")
    A.publish(spark, path, {"a": bank})
    broken = bank.withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception):
        A.publish(spark, path, {"a": bank.limit(1), "b": broken})
    assert A.load(spark, path)["a"].count() == 5 and A.published(spark, path).count() == 1


def test_made_anew_only_where_the_source_has_changed(spark, bank):
    path, made = scratch_path(spark, "artifact"), []

    def make(rows):
        return lambda: made.append(1) or {"a": rows}

    changed = bank.withColumn("label", F.when(F.col("bank_pos") != 2, F.col("label")))
    for rows in (bank, bank.orderBy(F.col("bank_pos").desc()), changed, bank):
        got = A.ensure(spark, path, A.fingerprint(rows), make(rows))
        assert sorted(got["a"].collect(), key=str) == sorted(rows.collect(), key=str)
    assert len(made) == 2
    other = bank.withColumn("label", F.when(F.col("bank_pos") != 2, F.col("label")).otherwise(""))
    assert len({A.fingerprint(x) for x in (bank, changed, other, bank.unionByName(bank), bank.limit(0))}) == 5


def test_a_model_without_labels(spark, bank):
    path = scratch_path(spark, "artifact")
    A.publish(spark, path, A.model_tables(linear.fit(bank.limit(0), row_id="bank_pos")))
    assert A.model_of(A.load(spark, path)).labels == ()
