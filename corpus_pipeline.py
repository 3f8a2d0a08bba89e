"""A training corpus from ``documents`` in five stages, each written and read again.

Toxic documents go, repeated lines go, one document of each near-duplicate group
stays, documents that hold benchmark items go, and the sources are mixed to equal
shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, line_dedup, mixing, near_dedup, queries, toxicity
from colloquy.llm.common import documents
from colloquy.session import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of being toxic is below one half; the chain is fitted on the labels of all documents."""
    return toxicity.drop_toxic(docs, queries.toxicity_chain(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; lines that five documents hold stay only in the document with the largest id."""
    done = line_dedup.dedup_lines(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and every text without words."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares, in a global random order."""
    return mixing.mix_sources(docs, total_repetitions=1.5, seed=queries.SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: The first stage is a fitted classifier, which SQL cannot express; tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
