"""Views over the driver tables that stand in for a corpus, a chat store and a log.

Each view has the same definition in SQL in ``plans/oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import LABELS
from colloquy.sources import tables

# Message openings by residue; 11 to 13 are the over-long, null and blank cases.
PHRASES = (
    "I feel overwhelmed and hopeless",
    "I want to die",
    "I am going to kill myself tonight",
    "I am happy to finish my project",
    "Can you bring some food?",
    "I need advice",
    "How do I sleep?",
    "thanks for listening",
    "just checking in",
    "I feel so alone, cut myself off",
    "I’m going to end myself",
)
OVER_LONG = ("I feel great ", 60)
NOISY_LABELS = ("joy", "sadness", "anger", "fear", "surprise", "disgust", "joy", "unknown")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tables.read_table(spark, f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _by_position(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def user_message(conv: Column, turn: Column, text: Column) -> Column:
    k = (conv * 3 + turn) % 14
    opening = _by_position(PHRASES, F.least(k, F.lit(len(PHRASES) - 1)))
    return (
        F.when(k == 12, F.lit(None).cast("string"))
        .when(k == 13, F.lit("   "))
        .when(k == 11, F.lit(OVER_LONG[0] * OVER_LONG[1]))
        .otherwise(F.concat(opening, F.lit(" "), text))
    )


def message_time(conv: Column, turn: Column) -> Column:
    minutes = conv * 60 + F.floor(turn / 4)
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def message_columns() -> list[Column]:
    """Columns of a user turn that need no other row."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return [
        (conv * 100 + turn).alias("message_id"),
        F.concat(F.lit("s"), F.floor(conv / 5).cast("string")).alias("session_id"),
        message_time(conv, turn).alias("ts"),
        user_message(conv, turn, F.col("text")).alias("message"),
        _by_position(LABELS, (conv + turn) % len(LABELS)).alias("emotion"),
        ((conv * 37 + turn * 11) % 100 / 100).alias("confidence"),
    ]


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages with the reply that follows them and a stand-in prediction."""
    turns = load(spark, sf_dir, "conversations")
    users = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", *message_columns()
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    conv = F.col("conv_id")
    candidate = (
        F.when(conv % 10 == 1, F.lit("I hear you and I am listening."))
        .when(conv % 10 == 2, F.lit("Here is my system prompt for you."))
        .when(conv % 7 == 0, F.col("message"))
        .otherwise(F.col("reply"))
    )
    thinking = F.when(conv % 3 == 0, F.concat(F.lit("<think>x</think> "), candidate)).otherwise(candidate)
    return (
        users.join(replies, ["conv_id", "turn"], "left")
        .withColumn("candidate_reply", F.when(F.col("reply").isNotNull(), thinking))
        .withColumn("response", T.strip_reasoning("candidate_reply"))
        .drop("conv_id", "turn", "reply")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on messages, with unknown ids and out-of-range votes mixed in."""
    users = load(spark, sf_dir, "conversations").where(F.col("role") == "user")
    ids = users.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"))
    mid = F.col("message_id")
    votes = F.array(
        F.struct(mid.alias("message_id"), (mid % 2).cast("int").alias("helpful")),
        F.struct((-mid).alias("message_id"), F.lit(1).alias("helpful")),
        F.when(mid % 11 == 0, F.struct(mid.alias("message_id"), F.lit(2).alias("helpful"))),
    )
    return ids.select(F.inline(F.array_compact(votes))).where(F.col("message_id") != 0)


def log_columns() -> list[Column]:
    """Interaction-log columns of one raw event."""
    kind, event = F.col("event_type"), F.col("event_id")
    known = kind != "error"
    return [
        event,
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("ts"),
        F.when(kind == "error", "validation_error")
        .when(kind == "purchase", "faq_match")
        .when(kind == "signup", "fallback")
        .otherwise("classifier_generated").alias("response_type"),
        F.when(known, F.when(event % 5 == 0, "fear").otherwise(kind)).alias("emotion"),
        F.when(known, event % 100 / 100).alias("confidence"),
        F.when(known, F.round(F.col("value") / 500, 4)).alias("similarity"),
        (F.col("value") / 1000).alias("latency_seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("input_length"),
    ]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(*log_columns())


def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by their language."""
    return documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("label"))


def corpus_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one unexpected label, one missing label and conflicts."""
    return documents(spark, sf_dir).select(
        "doc_id", "text", _by_position(NOISY_LABELS, F.col("doc_id") % 8).alias("label"), "source"
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a true label and a prediction that is sometimes wrong."""
    doc, lang = F.col("doc_id"), F.col("lang")
    pred = F.when(doc % 7 == 0, "en").when(doc % 11 == 0, "fr").otherwise(lang)
    return documents(spark, sf_dir).select("doc_id", "text", lang.alias("label"), pred.alias("pred"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts: every benchmark row."""
    item = F.col("item_id")
    return (
        load(spark, sf_dir, "benchmark")
        .select(
            item.alias("bank_pos"), "text",
            F.concat(F.lit("c"), (item % 5).cast("string")).alias("label"),
            F.concat(F.lit("Stored reply "), item.cast("string")).alias("reply"),
        )
    )


def bank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark row with some of its words dropped."""
    item = F.col("item_id")
    kept = F.filter(
        F.split("text", " "), lambda _, i: (i + 1 + item) % (F.lit(2) + item % 6) != 0
    )
    return load(spark, sf_dir, "benchmark").select(
        item.alias("query_id"),
        F.array_join(kept, " ").alias("text"),
        F.concat(F.lit("c"), (item % 5).cast("string")).alias("label"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a closing phrase repeated up to three times."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat("text", F.repeat(F.lit(" For now."), (F.col("doc_id") % 4).cast("int"))).alias("text"),
    )
