"""Message scoring, memory, feedback and table maintenance.

A message row has ``message_id, session_id, ts, message``; a scored one also
has ``emotion, confidence``. Generated replies arrive as input columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import constants as C
from colloquy.functions import rules as R
from colloquy.functions import text as T
from colloquy.operators import frames

SESSION = ["session_id"]
ORDER = ["ts", "message_id"]


def validate_messages(df: DataFrame, limit: int = C.MAX_INPUT_CHARS) -> DataFrame:
    """Add ``reason`` (null when accepted) and ``clean_message``."""
    reason = R.invalid_reason(F.col("message"), limit)
    return df.withColumns({
        "reason": reason,
        "clean_message": F.when(reason.isNull(), T.strip("message")),
    })


def accepted(df: DataFrame) -> DataFrame:
    """Valid rows, with the stripped text as ``message``."""
    return df.where(F.col("reason").isNull()).withColumn("message", F.col("clean_message")).drop("reason", "clean_message")


def quarantined(df: DataFrame) -> DataFrame:
    """Rejected rows with their reason."""
    return df.where(F.col("reason").isNotNull()).drop("clean_message")


def route(df: DataFrame, fold_quotes: bool = False) -> DataFrame:
    """Add risk level and intent to accepted messages."""
    return df.withColumns({
        "risk_level": R.risk_level(F.col("message"), fold_quotes),
        "intent": R.intent(F.col("message")),
    })


def session_messages(df: DataFrame, session_id: str) -> DataFrame:
    """All messages of a session in order; the filter reaches the scan."""
    return df.where(F.col("session_id") == session_id).orderBy(*ORDER)


def session_last_n(df: DataFrame, n: int | None = C.MEMORY_TURNS) -> DataFrame:
    """The newest ``n`` messages of every session; none or 0 keeps all.

    The limit is applied before the shuffle too, so a hot session sends at most
    ``n`` rows per input partition.
    """
    if not n:
        return df
    newest = F.row_number().over(W.partitionBy("session_id").orderBy(*[F.col(c).desc() for c in ORDER]))
    return df.withColumn("_r", newest).where(F.col("_r") <= n).drop("_r")


def with_history(df: DataFrame, n: int = C.MEMORY_TURNS, parts: int | None = None) -> DataFrame:
    """Add ``history``: the ``n`` earlier turns of the session, oldest first.

    Sessions are cut into ranges of rows, with ``n`` rows carried over each cut.
    """
    cut = frames.with_carry(df, SESSION, ORDER, n, parts)
    window = frames.chunk_window(SESSION, ORDER).rowsBetween(-n, -1)
    turns = F.collect_list(F.struct("message_id", "message", "response")).over(window)
    return cut.withColumn("history", turns).where(~F.col(frames.CARRIED)).drop(frames.CARRIED, frames.CHUNK)


def with_context(df: DataFrame) -> DataFrame:
    """Add the transcript of the history and the stance for a reply writer."""
    turn = F.transform(
        F.col("history"),
        lambda h: F.concat(
            F.lit("User: "), F.coalesce(h["message"], F.lit("None")),
            F.lit("\nAssistant: "), F.coalesce(h["response"], F.lit("None")),
        ),
    )
    transcript = F.when(F.size("history") > 0, F.array_join(turn, "\n")).otherwise(F.lit("(none)"))
    return df.withColumns({
        "transcript": transcript,
        "stance": R.stance_text(F.col("confidence")),
        "confidence_text": F.format_string("%.2f", F.col("confidence")),
    })


def check_replies(df: DataFrame, reply: str = "candidate_reply") -> DataFrame:
    """Add the cleaned reply and whether it may be sent."""
    clean = T.strip_reasoning(reply)
    earlier = F.transform(F.col("history"), lambda h: h["response"])
    return df.withColumns({
        "clean_reply": clean,
        "reply_valid": R.reply_is_valid(clean, F.col("message"), earlier),
    })


def apply_policy(
    df: DataFrame,
    candidates: Sequence[str] = ("candidate_reply",),
    low_confidence: float = C.LOW_CONFIDENCE,
) -> DataFrame:
    """Choose the reply and its type for routed, scored, accepted messages.

    Elevated risk takes the fixed safety reply, before anything else. Then come
    practical templates, the first valid generated reply, and templates by
    label or, below ``low_confidence``, the low-confidence ones. ``candidates``
    lists the columns with successive generated replies; an absent reply means
    the generator failed, and no columns mean it is switched off.
    """
    message, session = F.col("message"), F.col("session_id")
    normal = F.col("risk_level") == C.NORMAL
    practical = F.col("intent") == "practical_need"
    earlier = F.transform(F.col("history"), lambda h: h["response"]) if "history" in df.columns else None

    generated = F.lit(None).cast("string")
    outcome = F.lit(C.GENERATION_DISABLED if not candidates else C.GENERATION_REJECTED)
    for name in reversed(candidates):
        clean = T.strip_reasoning(name)
        valid = R.reply_is_valid(clean, message, earlier)
        missing = F.col(name).isNull()
        generated = F.when(missing, F.lit(None)).when(valid, clean).otherwise(generated)
        outcome = F.when(missing, C.GENERATION_UNAVAILABLE).when(valid, C.GENERATED).otherwise(outcome)

    low = R.template(F.lit(""), {}, C.LOW_CONFIDENCE_REPLIES, session, message)
    by_label = R.template(F.col("emotion"), C.REPLIES, C.LOW_CONFIDENCE_REPLIES, session, message)
    need = R.template(F.lit(""), {}, C.PRACTICAL_REPLIES, session, message)
    response = (
        F.when(~normal, R.safety_reply(F.col("risk_level")))
        .when(practical, need)
        .when(F.col("_generated").isNotNull(), F.col("_generated"))
        .when(F.col("confidence") < low_confidence, low)
        .otherwise(by_label)
    )
    kind = (
        F.when(~normal, C.SAFETY_OVERRIDE).when(practical, C.PRACTICAL_SUPPORT).otherwise(outcome)
    )
    return (
        df.withColumn("_generated", generated)
        .withColumns({
            "response": response,
            "response_type": kind,
            "emotion": F.when(normal, F.col("emotion")).otherwise("neutral"),
            "confidence": F.when(normal, F.col("confidence")).otherwise(F.lit(0.0)),
        })
        .drop("_generated")
    )


def score_messages(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    candidates: Sequence[str] = (),
    fold_quotes: bool = False,
    memory: int = C.MEMORY_TURNS,
) -> DataFrame:
    """Validate, remember, route, score and answer messages; rejected rows are left out.

    Rejected messages are never stored, so the history of a message holds
    accepted ones only. It is built where ``df`` has the stored ``response`` of
    its rows and generated replies are to be checked against it. ``scorer`` adds
    ``emotion`` and ``confidence`` and sees normal rows only: elevated ones are
    answered before any model runs. Without a scorer both columns must already be
    there.
    """
    rows = accepted(validate_messages(df))
    if candidates and memory and "response" in df.columns:
        rows = with_history(rows, memory)
    return answer(rows, scorer, candidates, fold_quotes)


def answer(
    accepted_rows: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, candidates: Sequence[str] = (),
    fold_quotes: bool = False,
) -> DataFrame:
    """Route, score and answer accepted messages, against ``history`` where they have it."""
    routed = route(accepted_rows, fold_quotes)
    if scorer is None:
        return apply_policy(routed, candidates)
    calm = scorer(routed.where(F.col("risk_level") == C.NORMAL))
    elevated = routed.where(F.col("risk_level") != C.NORMAL).withColumns({
        "emotion": F.lit("neutral"), "confidence": F.lit(0.0),
    })
    return apply_policy(calm.unionByName(elevated), candidates)


def stored_messages(scored: DataFrame, model_version: str, latency_ms: Column) -> DataFrame:
    """Rows of the message table from scored messages."""
    return scored.select(
        "message_id", "session_id", "message", "response", F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("emotion").alias("predicted_emotion"), F.col("confidence").cast("double").alias("confidence"),
        "intent", "risk_level", "response_type", F.lit(model_version).alias("model_version"),
        F.round(latency_ms.cast("double"), 2).alias("latency_ms"),
    )


def hybrid_route(
    df: DataFrame, matches: DataFrame, scorer: Callable[[DataFrame], DataFrame], limit: int = C.MAX_INPUT_CHARS
) -> DataFrame:
    """Stored reply where the bank matches, else classifier plus template.

    ``df`` has ``query_id, session_id, text``. ``matches`` gives, per
    ``query_id``, ``score, matched, matched_label, stored_reply``. ``scorer``
    adds ``emotion, confidence`` and only sees the misses.
    """
    reason = R.invalid_reason(F.col("text"), limit, C.ROUTE_EMPTY_MESSAGE, C.ROUTE_LONG_MESSAGE)
    checked = df.withColumn("reason", reason)
    rejected = checked.where(F.col("reason").isNotNull()).select(
        "query_id", "session_id", F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("string").alias("emotion"), F.lit(None).cast("double").alias("confidence"),
        F.lit(C.VALIDATION_ERROR).alias("response_type"), F.col("reason").alias("response"),
    )
    looked_up = (
        checked.where(F.col("reason").isNull()).withColumn("text", T.strip("text"))
        .join(matches.select("query_id", "score", "matched", "matched_label", "stored_reply"), "query_id")
    )
    similarity = F.round("score", 4).alias("similarity")
    hits = looked_up.where("matched").select(
        "query_id", "session_id", similarity, F.col("matched_label").alias("emotion"),
        F.round("score", 4).alias("confidence"), F.lit(C.STORED_MATCH).alias("response_type"),
        F.col("stored_reply").alias("response"),
    )
    misses = scorer(looked_up.where(~F.col("matched")).select("query_id", "session_id", "text", "score"))
    reply = R.template(F.col("emotion"), C.ROUTE_REPLIES, (C.FALLBACK_REPLY,), "session_id", "text")
    passes = T.passes_quality_gate("reply", "text")
    answered = misses.withColumn("reply", reply).select(
        "query_id", "session_id", similarity, "emotion", F.round("confidence", 4).alias("confidence"),
        F.when(passes, C.CLASSIFIED).otherwise(C.FALLBACK).alias("response_type"),
        F.when(passes, F.col("reply")).otherwise(C.FALLBACK_REPLY).alias("response"),
    )
    return rejected.unionByName(hits).unionByName(answered)


def to_log(routed: DataFrame, now: Column, latency: Column) -> DataFrame:
    """Interaction-log rows of :func:`hybrid_route` output joined with its text."""
    return routed.select(
        "session_id", now.alias("timestamp"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("input_length"),
        F.col("similarity").alias("faq_similarity_score"),
        F.col("emotion").alias("predicted_emotion"),
        F.col("confidence").alias("classifier_confidence"),
        "response_type", F.round(latency, 4).alias("latency_seconds"),
    )


# --- Feedback and table maintenance ----------------------------------------------------------

def _vote_in_range() -> Column:
    return F.coalesce(F.col("helpful").isin(0, 1), F.lit(False))


def feedback_accept(votes: DataFrame, messages: DataFrame) -> DataFrame:
    """Votes of 0 or 1 on known messages."""
    return votes.where(_vote_in_range()).join(messages.select("message_id"), "message_id", "left_semi")


def feedback_reject(votes: DataFrame, messages: DataFrame) -> DataFrame:
    """All other votes, with the reason."""
    bad = votes.where(~_vote_in_range()).withColumn("reason", F.lit("invalid_vote"))
    unknown = (
        votes.where(_vote_in_range())
        .join(messages.select("message_id"), "message_id", "left_anti")
        .withColumn("reason", F.lit("unknown_message"))
    )
    return bad.unionByName(unknown)


def delete_session(messages: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """The remaining messages, and a one-row count of the deleted ones."""
    gone = F.col("session_id") == session_id
    return (
        messages.where(~F.coalesce(gone, F.lit(False))),
        messages.where(gone).agg(frames.count_rows().alias("deleted_messages")),
    )


def cascade_feedback(votes: DataFrame, messages: DataFrame, session_id: str) -> DataFrame:
    """Votes without those on the deleted session's messages (opt-in)."""
    gone = messages.where(F.col("session_id") == session_id).select("message_id")
    return votes.join(gone, "message_id", "left_anti")


def retention(df: DataFrame, now: str, days: int = C.RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    """Rows no older than ``days`` before ``now``; a row exactly that old stays.

    On a table partitioned by day (``dt``) older days are not even listed.
    """
    cutoff = datetime.fromisoformat(now) - timedelta(days=days)
    kept = df.where(F.col(ts) >= F.lit(cutoff))
    return kept.where(F.col("dt") >= F.lit(cutoff.date())) if "dt" in df.columns else kept
