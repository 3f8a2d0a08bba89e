"""Schemas, readers and sinks. Every reader takes an explicit schema."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.constants import CORPUS_COLUMNS, DEFAULT_MATCH_THRESHOLD

CORPUS = T.StructType([T.StructField(name, T.StringType()) for name in CORPUS_COLUMNS])

LOG = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("input_length", T.LongType()),
    T.StructField("faq_similarity_score", T.DoubleType()),
    T.StructField("predicted_emotion", T.StringType()),
    T.StructField("classifier_confidence", T.DoubleType()),
    T.StructField("response_type", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
])

MESSAGES = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("predicted_emotion", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("intent", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("response_type", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
])

FEEDBACK = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("helpful", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])

CHOSEN = T.StructType([
    T.StructField("chosen_thresholds", T.MapType(T.StringType(), T.StructType([
        T.StructField("threshold", T.DoubleType()),
    ]))),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str = "", multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted commas, columns found by their header names and cast to ``schema``.

    The header must hold exactly the names of ``schema``, in any order. Quoted
    line breaks need ``multi_line``, with which a file is read by one task; a
    table without free text should turn it off, and large corpora be converted to
    Parquet once.
    """
    rows = (
        spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("nullValue", null_value).csv(path)
    )
    named = require_columns(rows, tuple(schema.fieldNames()))
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CORPUS)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LOG, multi_line=False)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, the format of everything the library writes itself."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def require_columns(df: DataFrame, expected: tuple[str, ...] = CORPUS_COLUMNS) -> DataFrame:
    """Fail unless the columns are exactly the expected set."""
    if set(df.columns) != set(expected):
        raise ValueError(f"expected columns {sorted(expected)}, found {sorted(df.columns)}")
    return df


def write_split(df: DataFrame, path: str) -> None:
    """One folder per split; ``split`` becomes the partition column."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append interaction-log rows."""
    df.select(*LOG.fieldNames()).write.mode("append").parquet(path)


def append_messages(df: DataFrame, path: str) -> None:
    """Append message rows under their day, which retention can prune on."""
    (
        df.select(*MESSAGES.fieldNames(), F.to_date("timestamp").alias("dt"))
        .write.mode("append").partitionBy("dt").parquet(path)
    )


def append_feedback(df: DataFrame, path: str) -> None:
    """Append accepted votes."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEEDBACK.fields]).write.mode("append").parquet(path)


def rewrite_where(spark: SparkSession, path: str, out: str, keep: Column, schema: T.StructType) -> int:
    """Write the rows of a day-partitioned table that ``keep`` holds for to ``out``; the number of rows left out.

    For a copy elsewhere; :func:`delete_where` and :func:`drop_days_before` change the table in place and
    touch only the days concerned.
    """
    rows = spark.read.schema(_by_day(schema)).parquet(path)
    kept = F.coalesce(keep, F.lit(False))
    rows.where(kept).write.partitionBy("dt").parquet(out)
    return rows.where(~kept).count()


#: Folder of a table that holds replacements of days; readers skip names that begin with an underscore.
STAGED = "_staged"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _by_day(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("dt", T.DateType())])


class Folder:
    """Listing, testing and deleting below a path, in whatever file system holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path, at = path.rstrip("/"), self._path(path)
        self._files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, below: str = "") -> list[str]:
        at = self._path(f"{self.path}/{below}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self._files.delete(self._path(f"{self.path}/{name}"), True)


def finish_rewrites(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Put staged days in place of the old ones; what was not staged to the end is thrown away.

    A job that dies while it stages has changed nothing, and one that dies later is completed
    by the next call: every step may be repeated.
    """
    folder = Folder(spark, path)
    for name in folder.names(STAGED):
        staged = f"{STAGED}/{name}"
        if folder.exists(f"{staged}/days/_SUCCESS"):
            days = [r[0] for r in spark.read.schema("dt date").parquet(f"{path}/{staged}/days").collect()]
            left = {x for x in folder.names(f"{staged}/rows") if x.startswith("dt=")}
            if left:
                rows = spark.read.schema(_by_day(schema)).parquet(f"{path}/{staged}/rows")
                (
                    rows.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy("dt").parquet(path)
                )
            for day in days:
                old = f"dt={_NO_DAY if day is None else day}"
                if old not in left:
                    folder.remove(old)
        folder.remove(staged)


def delete_where(spark: SparkSession, path: str, gone: Column, schema: T.StructType) -> int:
    """Delete the rows of a day-partitioned table that ``gone`` holds for; their number.

    The search reads the columns of the condition, which reaches the scan. Only
    days that hold such rows are rewritten: their other rows are staged inside the
    table's folder, then Spark's dynamic partition overwrite replaces those days.
    Files of other days are not touched. One writer at a time.
    """
    finish_rewrites(spark, path, schema)
    rows = spark.read.schema(_by_day(schema)).parquet(path)
    gone = F.coalesce(gone, F.lit(False))
    found = rows.where(gone).groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return 0
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    touched = F.lit(False)
    days = [r["dt"] for r in found]
    known = [F.lit(d) for d in days if d is not None]
    touched = F.coalesce(F.col("dt").isin(*known), F.lit(False)) if known else touched
    touched = touched | F.col("dt").isNull() if None in days else touched
    rows.where(touched & ~gone).write.partitionBy("dt").parquet(f"{staged}/rows")
    # Written last: with it the replacement is complete.
    spark.createDataFrame([(d,) for d in days], "dt date").coalesce(1).write.parquet(f"{staged}/days")
    finish_rewrites(spark, path, schema)
    return sum(r["n"] for r in found)


def drop_days_before(spark: SparkSession, path: str, cutoff: datetime, schema: T.StructType, ts: str = "timestamp") -> int:
    """Delete the rows of a day-partitioned table older than ``cutoff``; their number.

    The cutoff's own day is rewritten (:func:`delete_where`); earlier day folders are dropped,
    counted from their files' footers. Rows without a time stay.
    """
    old = F.col("dt") < F.lit(cutoff.date())
    rows = spark.read.schema(_by_day(schema)).parquet(path)
    dropped = rows.where(old).count()
    same_day = F.col("dt") == F.lit(cutoff.date())
    rewritten = delete_where(spark, path, same_day & (F.col(ts) < F.lit(cutoff)), schema)
    folder = Folder(spark, path)
    for name in folder.names():
        day = name.removeprefix("dt=")
        if name != day and day != _NO_DAY and date.fromisoformat(day) < cutoff.date():
            folder.remove(name)
    return dropped + rewritten


def write_document(df: DataFrame, path: str) -> None:
    """A small nested result as JSON, one document per row."""
    df.write.mode("overwrite").json(path)


def chosen_threshold(
    spark: SparkSession, path: str, measure: str, default: float = DEFAULT_MATCH_THRESHOLD
) -> float:
    """Threshold stored for a measure; the default when file or key is absent."""
    try:
        doc = spark.read.schema(CHOSEN).option("multiLine", True).json(path)
        row = doc.select(F.col("chosen_thresholds")[measure]["threshold"].alias("t")).first()
    except AnalysisException:
        return default
    return default if row is None or row["t"] is None else row["t"]
