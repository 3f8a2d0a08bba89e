"""Streams of messages and log rows.

The transformations are the batch operators; only sources, state and sinks are
added here. Paths and checkpoints belong in storage every executor can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.constants import LOW_CONFIDENCE
from colloquy.operators import messages, sessions
from colloquy.sources.tables import Folder

SEGMENT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("first_emotion", T.StringType()),
    T.StructField("last_emotion", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.StructType([
        T.StructField("from_emotion", T.StringType()),
        T.StructField("to_emotion", T.StringType()),
        T.StructField("n", T.LongType()),
    ]))),
])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and append it; the file sink commits each batch once."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


#: Folder of folded batches inside a table of changes; readers skip names that begin with an underscore.
FOLDED = "_folded"


def update_table(
    df: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, fold_every: int = 100,
) -> StreamingQuery:
    """Write what each batch changed, open groups included, below ``path``.

    A batch that runs again overwrites its own folder, so results count once. With
    ``keys``, every ``fold_every`` batches are folded into one state per group
    (:func:`fold_batches`), so that readers open a bounded number of folders. A path
    belongs to one checkpoint.
    """
    schema = df.schema

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys and (batch_id + 1) % fold_every == 0:
            fold_batches(batch.sparkSession, path, schema, keys, batch_id)

    return (
        df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(put).trigger(availableNow=True).start()
    )


def _folded(folder: Folder) -> list[int]:
    """The batches up to which complete folds exist."""
    names = [x for x in folder.names(FOLDED) if folder.exists(f"{FOLDED}/{x}/_SUCCESS")]
    return sorted(int(x.removeprefix("upto=")) for x in names)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest state of each group that :func:`update_table` wrote: the last fold and the batches after it."""
    folded = _folded(Folder(spark, path))[-1:]
    batch = T.StructField("batch", T.LongType())
    rows = spark.read.schema(T.StructType([*schema.fields, batch])).option("basePath", path).parquet(path)
    for upto in folded:
        older = spark.read.schema(schema).parquet(f"{path}/{FOLDED}/upto={upto}").withColumn("batch", F.lit(upto).cast("long"))
        rows = rows.where(F.col("batch") > upto).unionByName(older)
    newest = F.max_by(F.struct(*schema.fieldNames()), "batch").alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest).select("row.*")


def fold_batches(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], upto: int) -> None:
    """Fold the batches through ``upto`` into one state per group and remove their folders.

    A fold counts once it is written to the end; until then the batches stay, so a
    job that fails loses nothing and may be repeated.
    """
    folder = Folder(spark, path)
    latest(spark, path, schema, keys).write.mode("overwrite").parquet(f"{path}/{FOLDED}/upto={upto}")
    for name in folder.names():
        # The newest batch folder stays: a table needs one to be listed.
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < upto:
            folder.remove(name)
    for older in _folded(folder)[:-1]:
        folder.remove(f"{FOLDED}/upto={older}")


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "message_id", buckets: int = 64) -> StreamingQuery:
    """Append rows whose ``key`` is not stored yet, however long ago its first copy came.

    Rows are stored below ``batch`` and ``bucket``, a hash of the key. Before a batch
    is written it is anti-joined with the keys of the buckets it touches in earlier
    batches; only that column is read. No state is kept, and a batch that runs again
    overwrites its own folder. Of copies in one batch one is stored; rows without a
    key are always stored. A path belongs to one checkpoint.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    places = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
    stored = T.StructType([stream.schema[key], *places])

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", bucket)
        if Folder(spark, path).names():
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            known = (
                spark.read.schema(stored).parquet(path)
                .where((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).select("bucket", key)
            )
            fresh = fresh.join(known, ["bucket", key], "left_anti")
        without = batch.where(F.col(key).isNull()).withColumn("bucket", bucket)
        (
            fresh.unionByName(without).repartition("bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        )

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transitions_table(stream: DataFrame, path: str, checkpoint: str, id_col: str = "event_id", fold_every: int = 100) -> StreamingQuery:
    """Label transitions of a stream, as segments by session and day (:func:`live_transitions` adds them up).

    Each batch stores its labels under their day and counts the days it touches
    again, in ranges of rows; so rows may come late and in any order, and a batch that
    runs again changes nothing. The cost of a batch grows with its days, not with
    the age of the stream. A path belongs to one checkpoint.
    """
    schema = stream.select("session_id", "ts", id_col, "emotion").schema
    places = [T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())]
    stored = T.StructType([*schema.fields, *places])

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = batch.where(F.col("emotion").isNotNull()).select(*schema.fieldNames(), F.to_date("ts").alias("day"))
        known.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/labels/batch={batch_id}")
        rows = spark.read.schema(stored).option("basePath", f"{path}/labels").parquet(f"{path}/labels")
        days = [r.day for r in rows.where(F.col("batch") == batch_id).select("day").distinct().collect()]
        touched = F.col("day").isin([d for d in days if d is not None])
        touched = touched | F.col("day").isNull() if None in days else touched
        segments = sessions.transition_segments(rows.where(touched & (F.col("batch") <= batch_id)).drop("batch"), id_col)
        segments.write.mode("overwrite").parquet(f"{path}/segments/batch={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            fold_batches(spark, f"{path}/segments", SEGMENT, ["session_id", "day"], batch_id)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_transitions(spark: SparkSession, path: str) -> DataFrame:
    """Transition counts per session from what :func:`transitions_table` has written so far."""
    return sessions.merge_segments(latest(spark, f"{path}/segments", SEGMENT, ["session_id", "day"]))


def score_to(
    stream: DataFrame, scored_path: str, rejected_path: str, checkpoint: str, scorer=None, candidates=(),
    stored: DataFrame | None = None,
) -> StreamingQuery:
    """Score a stream of messages and quarantine the rejected ones, in one pass over the source.

    Each batch is scored by the batch operator. Replies are checked against the
    history in ``stored`` (accepted earlier messages with their responses) and in
    the batch itself. A batch that runs again overwrites its own two folders.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        checked = messages.validate_messages(rows)
        fresh = messages.accepted(checked)
        if stored is not None:
            columns = fresh.columns
            known = fresh.select("message_id")
            earlier = stored.join(known, "message_id", "left_anti").join(fresh.select("session_id").distinct(), "session_id", "left_semi")
            together = messages.with_history(fresh.unionByName(earlier.select(*columns)))
            fresh = together.join(known, "message_id", "left_semi")
        answered = messages.answer(fresh, scorer, candidates)
        answered.drop("history").write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")
        messages.quarantined(checked).write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_message(stream: DataFrame, delay: str = "1 hour", key: str = "message_id") -> DataFrame:
    """Drop repeats of a message id that arrive within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def session_partials(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Per session, label and day: counts that can be added up later.

    In update mode (:func:`update_table`) every change of a day comes out, the
    open day included. The watermark closes a day and drops its state, so state
    does not grow with the age of the stream. The first-seen time keeps the
    tie-break of the dominant label.
    """
    confidence = F.col("confidence")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "session_id", "emotion")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(confidence).alias("n_confidence"),
            F.sum(confidence).alias("sum_confidence"),
            F.sum((confidence < LOW_CONFIDENCE).cast("long")).alias("n_uncertain"),
            F.min(F.struct("ts", "event_id")).alias("first_seen"),
        )
        .select(F.col("window.start").alias("day"), "session_id", "emotion", "n", "n_confidence",
                "sum_confidence", "n_uncertain", "first_seen")
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Session totals from partial rows: summary and dominant label."""
    labels = partials.groupBy("session_id", "emotion").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_confidence", "sum_confidence", "n_uncertain")],
        F.min("first_seen").alias("first_seen"),
    )
    known = F.col("emotion").isNotNull()
    rank = F.when(known, F.struct(-F.col("n"), F.col("first_seen")))
    asked = F.sum("n_confidence")
    return labels.groupBy("session_id").agg(
        F.sum("n").alias("n_messages"),
        F.round(F.sum("sum_confidence") / F.when(asked > 0, asked), 4).alias("mean_confidence"),
        F.coalesce(F.round(F.sum("n_uncertain") / F.when(asked > 0, asked), 4), F.lit(0.0)).alias("uncertainty_rate"),
        F.min_by("emotion", rank).alias("dominant_emotion"),
    )


def running_totals(stream: DataFrame) -> DataFrame:
    """Live label counts per session for update mode.

    State is kept for every session seen; use :func:`session_partials` where
    sessions keep coming.
    """
    return stream.groupBy("session_id", "emotion").agg(F.count(F.lit(1)).alias("n"))
