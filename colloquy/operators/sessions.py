"""Analytics over an interaction log with ``session_id, ts, event_id`` ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.constants import LOW_CONFIDENCE
from colloquy.operators import frames

SESSION = ["session_id"]


def _order(id_col: str) -> list[str]:
    return ["ts", id_col]


def log_volume(log: DataFrame) -> DataFrame:
    """Messages, sessions, and messages per session."""
    per_session = log.groupBy("session_id").agg(frames.count_rows().alias("n"))
    return per_session.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count("session_id").alias("sessions"),
        F.round(F.avg("n"), 4).alias("mean_per_session"),
        F.max("n").alias("max_per_session"),
    )


def label_shares(log: DataFrame, column: str, keep_nulls: bool = False) -> DataFrame:
    """Rows per value and their percentage; nulls are left out unless asked for."""
    rows = log if keep_nulls else log.where(F.col(column).isNotNull())
    return frames.share_of_total(rows.groupBy(column).agg(frames.count_rows().alias("n")))


def routing_rates(log: DataFrame) -> DataFrame:
    """Share answered from the bank, share of fallbacks, mean similarity."""
    kind = F.col("response_type")
    return log.agg(
        frames.count_rows().alias("n"),
        F.round(F.avg((kind == "faq_match").cast("double")), 4).alias("match_rate"),
        F.round(F.avg((kind == "fallback").cast("double")), 4).alias("fallback_rate"),
        F.round(F.avg("similarity"), 4).alias("mean_similarity"),
    )


def label_pairs(
    log: DataFrame, id_col: str = "event_id", parts: int | None = None, keys: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Consecutive labels inside each session (or group of other ``keys``), nulls removed beforehand.

    Sessions are cut into ranges of rows, and one row is carried over each cut, so
    a very long session is spread over many tasks.
    """
    known = log.where(F.col("emotion").isNotNull()).select(*keys, "ts", id_col, "emotion")
    cut = frames.with_carry(known, keys, _order(id_col), 1, parts)
    before = F.lag("emotion").over(frames.chunk_window(keys, _order(id_col)))
    return (
        cut.withColumn("from_emotion", before)
        .where(~F.col(frames.CARRIED) & F.col("from_emotion").isNotNull())
        .select(*keys, "ts", id_col, "from_emotion", F.col("emotion").alias("to_emotion"))
    )


def transition_segments(rows: DataFrame, id_col: str = "event_id") -> DataFrame:
    """``session_id, day, first_emotion, last_emotion, pairs``: what is needed to add up transitions over days.

    ``rows`` has ``session_id, day, ts, emotion`` and the id. A segment is as small as
    the number of label pairs, however long its day is.
    """
    keys, place = ["session_id", "day"], F.struct("ts", id_col)
    ends = rows.where(F.col("emotion").isNotNull()).groupBy(*keys).agg(
        F.min_by("emotion", place).alias("first_emotion"), F.max_by("emotion", place).alias("last_emotion"),
    )
    counts = label_pairs(rows, id_col, keys=keys).groupBy(*keys, "from_emotion", "to_emotion").agg(frames.count_rows().alias("n"))
    pairs = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.collect_list(F.struct("from_emotion", "to_emotion", "n")).alias("pairs")
    )
    same = F.col("session_id").eqNullSafe(F.col("_session_id")) & F.col("day").eqNullSafe(F.col("_day"))
    return ends.join(pairs, same, "left").select(*keys, "first_emotion", "last_emotion", "pairs")


def merge_segments(segments: DataFrame) -> DataFrame:
    """Transition counts per session: those inside the days, and one at each seam between two days."""
    before = F.lag("last_emotion").over(W.partitionBy("session_id").orderBy("day"))
    seams = (
        segments.select("session_id", before.alias("from_emotion"), F.col("first_emotion").alias("to_emotion"))
        .where("from_emotion IS NOT NULL").withColumn("n", F.lit(1).cast("long"))
    )
    inside = segments.select("session_id", F.inline("pairs"))
    return inside.unionByName(seams).groupBy("session_id", "from_emotion", "to_emotion").agg(F.sum("n").alias("n"))


def emotion_transitions(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Transition counts over all sessions."""
    return label_pairs(log, id_col).groupBy("from_emotion", "to_emotion").agg(frames.count_rows().alias("n"))


def session_transitions(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Transition counts per session."""
    return (
        label_pairs(log, id_col)
        .groupBy("session_id", "from_emotion", "to_emotion").agg(frames.count_rows().alias("n"))
    )


def session_summary(
    log: DataFrame, uncertain_below: float = LOW_CONFIDENCE, exclude_overrides: bool = False
) -> DataFrame:
    """Length, mean confidence and uncertainty rate per session.

    ``exclude_overrides`` ignores the confidence of safety overrides, which is
    stored as 0 and would otherwise count as uncertain.
    """
    confidence = F.col("confidence")
    if exclude_overrides:
        confidence = F.when(F.col("response_type") != "safety_override", confidence)
    return log.groupBy("session_id").agg(
        frames.count_rows().alias("n_messages"),
        F.round(F.avg(confidence), 4).alias("mean_confidence"),
        F.coalesce(
            F.round(F.avg((confidence < uncertain_below).cast("double")), 4), F.lit(0.0)
        ).alias("uncertainty_rate"),
    )


def session_labels(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Label counts per session with the first time each label was seen."""
    return (
        log.where(F.col("emotion").isNotNull())
        .groupBy("session_id", "emotion")
        .agg(frames.count_rows().alias("n"), F.min(F.struct("ts", id_col)).alias("first_seen"))
    )


def session_dominant(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Most frequent label per session; the label seen first wins a tie."""
    rank = F.struct(-F.col("n"), F.col("first_seen"))
    return (
        session_labels(log, id_col).groupBy("session_id")
        .agg(
            F.min_by("emotion", rank).alias("dominant_emotion"),
            F.max("n").alias("n_dominant"),
            frames.count_rows().alias("n_labels"),
        )
    )


def session_timeline(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """One row per message; sorting by ``(ts, id)`` gives the mood timeline."""
    return log.select("session_id", "ts", id_col, "emotion", "confidence")


def session_report(log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Summary, dominant label and label map, one row per session.

    The label map holds one entry per distinct label, so it stays small however
    long the session is; transitions and timeline stay long tables.
    """
    labels = session_labels(log, id_col).groupBy("session_id").agg(
        F.min_by("emotion", F.struct(-F.col("n"), F.col("first_seen"))).alias("dominant_emotion"),
        F.map_from_entries(F.collect_list(F.struct("emotion", "n"))).alias("emotion_distribution"),
    )
    return session_summary(log).join(labels, "session_id", "left")


def session_detail(log: DataFrame, session_id: str, id_col: str = "event_id") -> DataFrame:
    """All of one session in a row: report, transition counts and the timeline in order.

    The filter reaches the scan, and the timeline is as long as that session.
    """
    rows = log.where(F.col("session_id") == session_id)
    moves = session_transitions(rows, id_col).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("from_emotion", "to_emotion", "n"))).alias("transitions")
    )
    steps = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), id_col, "emotion", "confidence")
    line = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(steps)).alias("timeline"))
    return session_report(rows, id_col).join(moves, "session_id", "left").join(line, "session_id", "left")


def confidence_by_type(log: DataFrame) -> DataFrame:
    """Confidence statistics per response type."""
    return frames.describe(log, ["response_type"], ["confidence"], continuous=True)
