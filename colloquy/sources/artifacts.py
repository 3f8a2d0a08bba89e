"""Versioned artifacts: sets of tables that are published together and found by a pointer.

``path/versions/<folder>/<table>`` holds the tables of a version in Parquet and
``path/current`` a row for each published version. The row is appended last, in one
commit, so a reader sees all tables of a version or none of them; a job that dies
before leaves a folder that nothing points to. Old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.operators.linear import LinearModel
from colloquy.operators.similarity import TfidfIndex

#: Part of every fingerprint: raise it when what is made from a table changes.
FORMAT = 1
POINTER = "version long, folder string, tag string, tables array<struct<name string, schema string>>"
LABELS = "position int, label string, bias double"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The pointer rows; none where nothing has been published."""
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/current")
    except AnalysisException:
        return spark.createDataFrame([], POINTER)


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], tag: str = "") -> int:
    """Write the tables as a new version and point to it; its number. ``tag`` says what it was made from."""
    folder = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/versions/{folder}/{name}")
    last = published(spark, path).agg(F.max("version").alias("v")).first().v
    version = 1 if last is None else last + 1
    named = [(name, table.schema.json()) for name, table in tables.items()]
    row = spark.createDataFrame([(version, folder, tag, named)], POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def load(spark: SparkSession, path: str, version: int | None = None, tag: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version, or of the newest with this number or tag.

    Two writers at the same time may take one number; the folder's name then decides, alike for every reader.
    """
    rows = published(spark, path)
    rows = rows if version is None else rows.where(F.col("version") == version)
    rows = rows if tag is None else rows.where(F.col("tag") == tag)
    newest = rows.agg(F.max(F.struct("version", "folder", "tables")).alias("m")).first().m
    if newest is None:
        raise LookupError(f"no such version is published in {path}")
    base = f"{path}/versions/{newest.folder}"
    return {
        t.name: spark.read.schema(StructType.fromJson(json.loads(t.schema))).parquet(f"{base}/{t.name}") for t in newest.tables
    }


def ensure(spark: SparkSession, path: str, tag: str, make: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """The newest version made from ``tag``; made and published where there is none."""
    try:
        return load(spark, path, tag=tag)
    except LookupError:
        publish(spark, path, make(), tag)
        return load(spark, path, tag=tag)


def fingerprint(df: DataFrame) -> str:
    """Rows and a sum of their hashes, in one scan: equal tables have equal fingerprints, in any order of rows."""
    whole = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
    # Null and empty hash alike unless told apart.
    told = F.xxhash64(F.concat_ws("", *[F.col(c).isNull().cast("string") for c in df.columns]), whole).cast("decimal(20,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(told).alias("h")).first()
    return f"{FORMAT}-{row.n}-{row.h}"


def model_tables(model: LinearModel, prefix: str = "") -> dict[str, DataFrame]:
    """A linear model as two tables: one row per term, one per label."""
    rows = [(i, label, bias) for i, (label, bias) in enumerate(zip(model.labels, model.bias))]
    return {f"{prefix}terms": model.terms, f"{prefix}labels": model.terms.sparkSession.createDataFrame(rows, LABELS)}


def model_of(tables: Mapping[str, DataFrame], prefix: str = "") -> LinearModel:
    """The model that :func:`model_tables` wrote; only its labels pass through the driver."""
    heads = tables[f"{prefix}labels"].orderBy("position").collect()
    return LinearModel(tables[f"{prefix}terms"], tuple(r.label for r in heads), tuple(r.bias for r in heads))


def index_tables(index: TfidfIndex) -> dict[str, DataFrame]:
    return {"postings": index.postings, "blocks": index.blocks}


def index_of(tables: Mapping[str, DataFrame]) -> TfidfIndex:
    return TfidfIndex(tables["postings"], tables["blocks"])
