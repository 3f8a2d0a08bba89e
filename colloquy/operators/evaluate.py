"""Metrics of predictions. Input: ``doc_id, text, label, pred`` unless stated.

Every metric is derived from the confusion cells, one row per (label, pred)
pair, so the predictions are shuffled once and only as counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import LONG_QUANTILE, SHORT_WORDS, STATUS_CV, STATUS_HELD_OUT, STATUS_PENDING
from colloquy.operators import frames
from colloquy.operators.frames import count_rows
from colloquy.session import materialize



def cells(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the label pairs that occur."""
    return preds.groupBy(*by, "label", "pred").agg(count_rows().alias("n"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """Dense matrix as rows (true label, predicted label, n), zeros kept."""
    found = cells(preds)
    names = found.select(F.explode(F.array("label", "pred")).alias("name"))
    axis = names.agg(F.array_sort(F.collect_set("name")).alias("axis"))
    grid = (
        axis.select(F.explode("axis").alias("label"), "axis")
        .select("label", F.explode("axis").alias("pred"))
    )
    return grid.join(found, ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def confused_pairs(preds: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent kinds of error."""
    return (
        cells(preds).where(F.col("label") != F.col("pred"))
        .orderBy(F.col("n").desc(), "label", "pred").limit(n)
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _per_class(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unrounded precision, recall and F1 per label seen as true or predicted."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(none)

    def side(name: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(name).alias("name"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits")
        )

    sides = F.array(side("label", n, none, hit), side("pred", none, n, none))
    sums = cells(preds, by).select(*by, F.inline(sides)).groupBy(*by, F.col("name").alias("label")).agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        sums
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2 * p * r, p + r))
    )


def per_class_report(preds: DataFrame) -> DataFrame:
    return _per_class(preds).select(
        "label", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"), "support",
    )


def overall_metrics(preds: DataFrame, by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """Accuracy, and macro and weighted precision, recall and F1; unrounded with ``digits=None``."""
    s = F.col("support")

    def shown(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    def weighted(c: str) -> Column:
        return shown(F.sum(F.col(c) * s) / F.sum(s))

    return _per_class(preds, by).groupBy(*by).agg(
        F.sum("support").alias("n"),
        shown(F.sum("hits") / F.sum(s)).alias("accuracy"),
        shown(F.avg("precision")).alias("macro_precision"),
        shown(F.avg("recall")).alias("macro_recall"),
        shown(F.avg("f1")).alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )


def imbalance_report(preds: DataFrame) -> DataFrame:
    """Gap between macro and weighted F1, the F1 range, and class sizes."""
    s = F.col("support")
    weighted = F.sum(F.col("f1") * s) / F.sum(s)
    return _per_class(preds).agg(
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(weighted, 4).alias("weighted_f1"),
        F.round(F.avg("f1") - weighted, 4).alias("f1_gap"),
        F.round(F.min("f1"), 4).alias("min_f1"),
        F.round(F.max("f1"), 4).alias("max_f1"),
        F.round(F.max(s) / F.min(F.when(s > 0, s)), 3).alias("imbalance_ratio"),
    )


def error_by_length(preds: DataFrame) -> DataFrame:
    """Errors in total, among short rows, and among the longest rows.

    Texts are tokenized once; everything comes from one count per length and
    outcome.
    """
    wrong, wc = F.col("wrong"), F.col("word_count")
    counted = materialize(
        preds.select((F.col("label") != F.col("pred")).alias("wrong"), T.word_count("text").alias("word_count"))
        .groupBy("wrong", "word_count").agg(count_rows().alias("_n")), "lengths",
    )
    long_words = counted.where(wc.isNotNull()).agg(frames.quantile("word_count", LONG_QUANTILE).alias("q")).scalar()

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    rows = count(F.lit(True))
    return counted.withColumn("long_words", long_words).agg(
        rows.alias("n"),
        count(wrong).alias("n_errors"),
        F.round(F.try_divide(100 * count(wrong), rows), 2).alias("error_pct"),
        count(wrong & (wc <= SHORT_WORDS)).alias("short_errors"),
        count(wrong & (wc >= F.col("long_words"))).alias("long_errors"),
    )


def error_examples(preds: DataFrame, n: int = 10) -> DataFrame:
    return (
        preds.where(F.col("label") != F.col("pred")).orderBy("doc_id").limit(n)
        .select("doc_id", "label", "pred")
    )


METRICS = ("accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall")


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean, population deviation and fold scores of each metric per model.

    Input: ``model, fold`` and the metric columns; a model has one row per fold.
    """
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])
    long = fold_metrics.select("model", "fold", F.inline(scores))
    ordered = F.array_sort(F.collect_list(F.struct("fold", "score")))
    return long.groupBy("model", "metric").agg(
        F.round(F.avg("score"), 4).alias("mean"),
        F.round(F.stddev_pop("score"), 4).alias("std"),
        F.transform(ordered, lambda s: F.round(s["score"], 4)).alias("fold_scores"),
    )


def select_model(summary: DataFrame) -> DataFrame:
    """Highest mean weighted F1; the steadier model wins a tie."""
    return (
        summary.where(F.col("metric") == "weighted_f1")
        .orderBy(F.col("mean").desc(), "std", "model").limit(1)
        .select("model", "mean", "std")
    )


def comparison_table(summary: DataFrame, held_out: DataFrame | None, pending: str | None) -> DataFrame:
    """Cross-validated models, plus a held-out or a pending row."""
    def value(metric: str, field: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(field)))

    chosen = ("accuracy", "macro_f1", "weighted_f1")
    table = summary.groupBy("model").agg(
        *[value(m, "mean").alias(m) for m in chosen],
        *[value(m, "std").alias(f"{m}_std") for m in chosen],
    ).withColumn("status", F.lit(STATUS_CV))
    if held_out is not None:
        extra = held_out.select("model", *chosen).withColumn("status", F.lit(STATUS_HELD_OUT))
        return table.unionByName(extra, allowMissingColumns=True)
    if pending is not None:
        extra = summary.sparkSession.range(1).select(
            F.lit(pending).alias("model"), F.lit(STATUS_PENDING).alias("status")
        )
        return table.unionByName(extra, allowMissingColumns=True)
    return table
