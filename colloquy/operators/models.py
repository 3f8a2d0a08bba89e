"""Text classifiers on MLlib: features, three linear models, selection, scoring.

Input frames have ``doc_id, text, label``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import FOLDS, SPLIT_SEED
from colloquy.operators import evaluate, split
from colloquy.session import materialize

LOGREG = "TF-IDF + Logistic Regression"
SVM = "TF-IDF + Linear SVM"
BAYES = "TF-IDF + Multinomial Naive Bayes"
MODELS = (LOGREG, SVM, BAYES)

MIN_DF = 2
#: Labelled rows a model is fitted on, at most about; drawn by a seeded hash of the row id.
FIT_ROWS = 200_000
#: Fits end when they converge to TOLERANCE, or after so many iterations.
MAX_ITER, TOLERANCE = 1000, 1e-4
PARALLEL_FITS = 4
_ALL_TERMS = 2**31 - 1


def with_terms(df: DataFrame) -> DataFrame:
    """Add the unigram and bigram array that the vectorizer counts."""
    return df.withColumn("terms", T.ngrams_1_2(T.model_tokens("text")))


def fit_sample(df: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SPLIT_SEED, row_id: str = "doc_id") -> DataFrame:
    """About ``fit_rows`` rows, chosen by a seeded hash; all rows if there are no more."""
    rows = df.count()
    if rows <= fit_rows:
        return df
    position = F.conv(F.substring(split.seeded_hash(F.col(row_id).cast("string"), seed), 1, 8), 16, 10).cast("long")
    return df.where(position < int(fit_rows / rows * (1 << 32)))


def fit_counts(df: DataFrame, min_df: int = MIN_DF) -> Model:
    """Counts of all terms found in at least ``min_df`` of the rows.

    The vocabulary is on the driver and in every task; the number of rows that a
    model is fitted on (``FIT_ROWS``) bounds it.
    """
    return CountVectorizer(inputCol="terms", outputCol="tf", minDF=min_df, vocabSize=_ALL_TERMS).fit(df)


def fit_weights(counted: DataFrame) -> list[Model]:
    """Smoothed idf and unit length on top of the counts.

    MLlib's idf is ln((n+1)/(df+1)) without the added 1, so the fitted idf plus
    one becomes an element-wise factor.
    """
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted)
    factor = Vectors.dense(idf.idf.toArray() + 1.0)
    return [
        ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=factor),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
    ]


def classifier(name: str, rows: int, max_iter: int = MAX_ITER) -> Estimator:
    """One of the three linear models; unit cost is written as 1/n regularization."""
    strength = 1.0 / max(rows, 1)
    if name == LOGREG:
        return LogisticRegression(
            featuresCol="features", labelCol="target", family="multinomial", maxIter=max_iter, tol=TOLERANCE,
            regParam=strength,
        )
    if name == SVM:
        svm = LinearSVC(maxIter=max_iter, tol=TOLERANCE, regParam=strength)
        return OneVsRest(classifier=svm, featuresCol="features", labelCol="target", parallelism=PARALLEL_FITS)
    if name == BAYES:
        return NaiveBayes(featuresCol="features", labelCol="target", modelType="multinomial", smoothing=1.0)
    raise ValueError(f"unknown model {name!r}")


def fit_models(
    train: DataFrame, names: Sequence[str] = MODELS, max_iter: int = MAX_ITER, fit_rows: int = FIT_ROWS,
    tasks: int | None = None, row_id: str = "doc_id",
) -> dict[str, PipelineModel]:
    """Fit the named models on one set of features, fitted on the same rows.

    Each task returns a gradient as long as the vocabulary; ``tasks`` sets how
    many there are, else the partitions of the input do.

    Only the sparse counts are kept between passes; they are smaller than the
    texts, unlike the n-gram arrays they come from.
    """
    train = fit_sample(train, fit_rows, row_id=row_id)
    terms = with_terms(train).select("terms", "label")
    labels = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(train)
    counts = fit_counts(terms)
    counted = labels.transform(counts.transform(terms)).select("tf", "target").persist(StorageLevel.MEMORY_AND_DISK)
    rows = counted.count()
    weights = fit_weights(counted)
    ready = PipelineModel(stages=weights).transform(counted).select("features", "target")
    ready = ready.coalesce(tasks) if tasks else ready
    names_back = IndexToString(inputCol="prediction", outputCol="pred", labels=list(labels.labels))
    try:
        return {
            name: PipelineModel(stages=[counts, *weights, classifier(name, rows, max_iter).fit(ready), names_back])
            for name in names
        }
    finally:
        counted.unpersist()


def confidence(model: PipelineModel) -> Column:
    """Largest probability, or the largest softmax of the margins.

    The softmax of margins is shifted by the largest margin; it is a measure of
    uncertainty, not a calibrated probability.
    """
    if hasattr(model.stages[-2], "getProbabilityCol"):
        return F.array_max(vector_to_array(F.col("probability")))
    margins = vector_to_array(F.col("rawPrediction"))
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda acc, m: acc + F.exp(m - top))
    return 1.0 / total


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``pred`` and ``confidence`` to the rows."""
    keep = df.columns
    return model.transform(with_terms(df)).select(*keep, "pred", confidence(model).alias("confidence"))


def scorer(model: PipelineModel, text: str = "message") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``emotion`` and ``confidence`` to message rows."""
    def apply(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("emotion", "confidence")]
        rows = df.select(*keep) if text == "text" else df.select(*keep).withColumn("text", F.col(text))
        scored = predict(model, rows).withColumnRenamed("pred", "emotion")
        return scored.select(*keep, "emotion", "confidence")

    return apply


def cross_validate(
    train: DataFrame, names: Sequence[str] = MODELS, folds: int = FOLDS, max_iter: int = MAX_ITER,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Metrics per model and fold; the vectorizer is fitted anew in each fold.

    The driver only starts the fits, a few at a time; rows stay in Spark.
    """
    dealt = materialize(split.stratified_folds(train), "folds")

    def one_fold(fold: int) -> list[DataFrame]:
        fitted = fit_models(dealt.where(F.col("fold") != fold), names, max_iter)
        held = dealt.where(F.col("fold") == fold)
        return [
            predict(model, held).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "label", "pred")
            for name, model in fitted.items()
        ]

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        parts = [part for group in pool.map(one_fold, range(folds)) for part in group]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return materialize(evaluate.overall_metrics(together, ["model", "fold"], digits=None), "fold-metrics")


def best_name(summary: DataFrame) -> str:
    """Name of the selected model (one row)."""
    return evaluate.select_model(summary).first()["model"]


def save(model: PipelineModel, path: str) -> None:
    """Vectorizer, classifier and label names as one artifact."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.read().load(path)
