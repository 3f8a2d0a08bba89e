"""Toxicity by a classifier chain over linear models."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import modest_batches, uniform, whole_text
from colloquy.session import materialize

#: Labelled rows that a model is fitted on, at most about; drawn by a hash of the id.
FIT_ROWS = 20_000
#: Words kept as features for each category, those whose shares differ most surely.
MOST_WORDS = 500
LEAST_ROWS, LEAST_Z = 8, 4.0
FOLDS = 3
#: Categories in the order of the chain.
CATEGORIES = ("low_quality", "toxic")
_LETTERS = re.compile(r"[^\W\d_]+")
SHAPES = 4
#: Lengths of word beginnings that are features too: inflected and compound words share them.
BEGINNINGS = (3, 4, 6)


def read(text: str | None) -> tuple[list[float], list[str]]:
    """Shape of a whole text (share of letters, of capital words, words per line, variety), its distinct words and their beginnings."""
    text = text or ""
    all_words = _LETTERS.findall(text)
    distinct = {w.lower() for w in set(all_words)}
    n = max(1, len(all_words))
    shape = [
        sum(map(len, all_words)) / max(1, len(text)), sum(map(str.isupper, all_words)) / n,
        min(1.0, n / 100 / (1 + text.count("\n"))), len(distinct) / n,
    ]
    return shape, sorted(distinct.union(w[:n] + "*" for n in BEGINNINGS for w in distinct if len(w) > n))


@dataclass(frozen=True)
class Chain:
    """Fitted chain: the place of each word, and for each category weights over shapes, words and earlier logits."""

    categories: tuple[str, ...]
    places: dict[str, int]
    weights: list[np.ndarray]
    biases: list[float]

    def scores(self, text: str | None) -> list[float]:
        """Probability of each category, in the order of the chain."""
        shape, found = read(text)
        at = [SHAPES + self.places[w] for w in found if w in self.places]
        earlier = SHAPES + len(self.places)
        out: list[float] = []
        for weights, bias in zip(self.weights, self.biases):
            logit = bias + weights[:SHAPES] @ shape + weights[at].sum() + weights[earlier:] @ np.array(out)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
        return out


_READ = T.StructType([
    T.StructField("shape", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_READ)
def _read(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(text) for text in texts], columns=["shape", "words"])


def labelled_rows(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], fit_rows: int, doc_id: str, text: str,
) -> DataFrame:
    """Shape and words of about ``fit_rows`` labelled documents, each text once, with its categories as 0 or 1.

    The labels to fit on are drawn first; that list has a known bound and is the
    one thing broadcast, so documents are neither shuffled nor read twice.
    """
    usable = labels.select(F.col(doc_id).alias("_label_id"), *[F.col(c).cast("double").alias(c) for c in categories]).dropna()
    share = min(1.0, fit_rows / max(1, usable.count()))
    drawn = usable.where(uniform(F.col("_label_id").cast("string"), F.lit("fit")) < share)
    texts = docs.select(F.col(doc_id).alias("_label_id"), whole_text(text).alias("_text"))
    rows = (
        texts.join(F.broadcast(drawn), "_label_id")
        .groupBy(F.sha2("_text", 256).alias("key"))
        .agg(F.first("_text").alias("_text"), *[F.round(F.avg(c)).alias(c) for c in categories])
    )
    return materialize(
        rows.withColumn("_read", _read("_text"))
        .select("key", "_read.*", *categories, F.pmod(F.xxhash64("key"), F.lit(FOLDS)).alias("fold")), "labelled",
    )


def telling_words(rows: DataFrame, category: str, most: int) -> list[str]:
    """The words whose share differs most surely between rows in and out of a category (z of the log odds)."""
    inside = rows.agg(F.sum(category).alias("a"), F.count(F.lit(1)).alias("n")).first()
    a, n = inside.a or 0, inside.n
    with_word = F.col("hits") + 0.5
    z = F.log(with_word * (n - a + 1) / ((F.col("rows") - F.col("hits") + 0.5) * (a + 1))) / F.sqrt(
        1 / with_word + 1 / (F.col("rows") - F.col("hits") + 0.5)
    )
    counted = (
        rows.select(F.explode("words").alias("word"), category)
        .groupBy("word").agg(F.count(F.lit(1)).alias("rows"), F.sum(category).alias("hits"))
        .where(F.col("rows") >= LEAST_ROWS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    )
    return [row.word for row in counted.orderBy(F.desc("z"), "word").limit(most).collect()]


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, fit_rows: int = FIT_ROWS,
    most_words: int = MOST_WORDS, doc_id: str = "doc_id", text: str = "text",
) -> Chain:
    """Fit one logistic model per category; each sees the probabilities of the categories before it.

    Training rows get those probabilities from models that have not seen them
    (three folds by hash), so that a later model learns how far to trust an
    earlier one. Fitting is on about ``fit_rows`` labelled rows, drawn by hash,
    and on the ``most_words`` words per category that tell it best. Rows with a
    null in any category are left out; equal texts count once, with the majority
    of their labels. Without labelled rows every probability is near 0.
    """
    modest_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, categories, fit_rows, doc_id, text)
    chosen = sorted({word for category in categories for word in telling_words(rows, category, most_words)})
    places = {word: i for i, word in enumerate(chosen)}
    total = SHAPES + len(places)
    if rows.isEmpty():
        zeros = [np.zeros(total + i) for i in range(len(categories))]
        return Chain(tuple(categories), places, zeros, [-30.0] * len(categories))

    def vector(earlier: int):
        size = total + earlier

        @F.udf(VectorUDT())
        def build(shape, words, probabilities):
            values = dict(enumerate(shape)) | {SHAPES + places[w]: 1.0 for w in words if w in places}
            values |= {total + i: p for i, p in enumerate(probabilities)}
            return Vectors.sparse(size, values)

        return build("shape", "words", "probabilities")

    learner = LogisticRegression(maxIter=50, regParam=1e-3, labelCol="label")
    rows = rows.withColumn("probabilities", F.array().cast("array<double>"))
    weights, biases = [], []
    for i, category in enumerate(categories):
        data = materialize(rows.select("key", "fold", F.col(category).alias("label"), vector(i).alias("features")), "fit")
        model = learner.fit(data)
        weights.append(np.array(model.coefficients.toArray()))
        biases.append(float(np.clip(model.intercept, -30, 30)))
        if i + 1 < len(categories):
            parts = []
            for fold in range(FOLDS):
                others = data.where(F.col("fold") != fold)
                own = model if others.isEmpty() else learner.fit(others)
                parts.append(
                    own.transform(data.where(F.col("fold") == fold))
                    .select("key", F.element_at(vector_to_array("probability"), -1).alias("_p"))
                )
            unseen = materialize(reduce(DataFrame.unionByName, parts), "unseen")
            rows = (
                rows.join(unseen, "key")
                .withColumn("probabilities", F.array_append("probabilities", F.col("_p"))).drop("_p")
            )
    return Chain(tuple(categories), places, weights, biases)


def score_column(chain: Chain, spark: SparkSession, text: str = "text") -> Column:
    """A struct of the probability of each category. Null text counts as empty.

    Whole texts are read in one pass without a shuffle; the chain sent along has
    a fixed size.
    """
    modest_batches(spark)
    shared = spark.sparkContext.broadcast(chain)

    @F.pandas_udf("struct<" + ", ".join(f"{c}: double" for c in chain.categories) + ">")
    def scores(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.scores(x) for x in texts], columns=list(chain.categories), dtype="float64")

    return scores(F.col(text))


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the struct ``toxicity``; a column of that name gives way."""
    return docs.withColumn("toxicity", score_column(chain, docs.sparkSession, text))


def drop_toxic(
    docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5, text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, as they are, whose probability of ``category`` is below ``threshold``."""
    return docs.where(score_column(chain, docs.sparkSession, text)[category] < threshold)
