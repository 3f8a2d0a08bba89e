import pytest

from colloquy.operators import evaluate as E


@pytest.fixture(scope="module")
def preds(spark):
    pairs = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [("c", "a")] * 2
    rows = [(i, "word " * (i % 5 + 1), *p) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, pred string")


def test_confusion_is_dense_and_complete(preds):
    rows = E.confusion_matrix(preds).collect()
    assert len(rows) == 9 and sum(r.n for r in rows) == 14
    assert [tuple(r) for r in E.confused_pairs(preds, 2).collect()] == [("a", "b", 2), ("c", "a", 2)]


def test_metrics(preds):
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.per_class_report(preds).collect()}
    assert got == {"a": (0.75, 0.75, 0.75, 8), "b": (0.6, 0.75, 0.6667, 4), "c": (0.0, 0.0, 0.0, 2)}
    row = E.overall_metrics(preds).first()
    assert (row.n, row.accuracy, row.macro_f1, row.weighted_f1) == (14, 0.6429, 0.4722, 0.619)
    assert E.imbalance_report(preds).first().imbalance_ratio == 4.0


def test_errors(preds):
    row = E.error_by_length(preds).first()
    assert (row.n_errors, row.error_pct) == (5, 35.71)
    assert [r.doc_id for r in E.error_examples(preds, 2).collect()] == [6, 7]
    assert E.error_by_length(preds.where("false")).first().n == 0


def test_selection_and_comparison(spark):
    cols = "model string, fold int, accuracy double, macro_f1 double, weighted_f1 double, macro_precision double, macro_recall double"
    rows = [("steady", k, 0.9, 0.9, 0.9, 0.9, 0.9) for k in range(2)]
    rows += [("shaky", k, 0.9, 0.9, 0.8 + 0.2 * k, 0.9, 0.9) for k in range(2)]
    rows += [("worse", k, 0.5, 0.5, 0.5, 0.5, 0.5) for k in range(2)]
    summary = E.cv_summary(spark.createDataFrame(rows, cols))
    shaky = summary.where("model = 'shaky' and metric = 'weighted_f1'").first()
    assert (shaky["mean"], shaky["std"], shaky["fold_scores"]) == (0.9, 0.1, [0.8, 1.0])
    assert E.select_model(summary).first().model == "steady"
    table = {r.model: r for r in E.comparison_table(summary, None, "later").collect()}
    assert table["later"].accuracy is None and table["later"].status.startswith("PENDING") and len(table) == 4
