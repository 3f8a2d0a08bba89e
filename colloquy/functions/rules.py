"""Message rules as column expressions: validation, risk, intent, replies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import constants as C
from colloquy.functions import text as T


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _contains_any(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def invalid_reason(
    message: Column,
    limit: int = C.MAX_INPUT_CHARS,
    empty: str = C.EMPTY_MESSAGE,
    too_long: str = C.LONG_MESSAGE,
) -> Column:
    """Why a message is rejected; null when it is accepted."""
    return (
        F.when(T.is_blank(message), F.lit(empty))
        .when(F.char_length(T.strip(message)) > limit, F.lit(too_long.format(limit=limit)))
    )


def straight_quotes(message: Column) -> Column:
    """Curly single quotes as straight ones, so contractions meet the patterns."""
    return F.regexp_replace(message, "[‘’]", "'")


def risk(message: Column, fold_quotes: bool = False) -> Column:
    """``struct(level, matched_signals)`` of the most severe tier that matches."""
    message = straight_quotes(message) if fold_quotes else message
    tiers = []
    for level, patterns in C.RISK_PATTERNS:
        hits = F.array_compact(
            F.array(*[F.when(message.rlike(f"(?iU){p}"), F.lit(p)) for p in patterns])
        )
        tiers.append(F.when(F.size(hits) > 0, F.struct(F.lit(level).alias("level"), hits.alias("matched_signals"))))
    calm = F.struct(
        F.lit(C.NORMAL).alias("level"), F.array().cast("array<string>").alias("matched_signals")
    )
    return F.coalesce(*tiers, calm)


def risk_level(message: Column, fold_quotes: bool = False) -> Column:
    """Only the level: one regular expression per tier, tried in order."""
    message = straight_quotes(message) if fold_quotes else message
    chain = None
    for level, patterns in C.RISK_PATTERNS:
        hit = message.rlike("(?iU)" + "|".join(patterns))
        chain = F.when(hit, F.lit(level)) if chain is None else chain.when(hit, F.lit(level))
    return chain.otherwise(F.lit(C.NORMAL))


def intent(message: Column) -> Column:
    """Ordered substring tests; the first that holds names the intent."""
    lower = F.lower(message)
    starts = F.lit(False)
    for opening in C.QUESTION_STARTS:
        starts = starts | lower.startswith(opening)
    return (
        F.when(_contains_any(lower, C.NEED_WORDS), "practical_need")
        .when(_contains_any(lower, C.HELP_WORDS), "support_request")
        .when(F.contains(message, F.lit("?")) | starts, "question")
        .when(_contains_any(lower, C.THANKS_WORDS), "gratitude")
        .otherwise("check_in")
    )


def stance(confidence: Column, low: float = C.CLARIFY_BELOW, high: float = C.CAUTIOUS_BELOW) -> Column:
    """How firmly a reply may lean on the predicted label."""
    return (
        F.when(confidence.isNull(), F.lit(None))
        .when(confidence < low, "clarify")
        .when(confidence < high, "cautious")
        .otherwise("clear")
    )


def stance_text(confidence: Column) -> Column:
    name = stance(confidence)
    return (
        F.when(name == "clarify", C.STANCE_CLARIFY)
        .when(name == "cautious", C.STANCE_CAUTIOUS)
        .when(name == "clear", C.STANCE_CLEAR)
    )


def reply_is_valid(reply: Column, message: Column, history: Column | None = None) -> Column:
    """Length, banned phrases, echo and repetition checks on a generated reply.

    ``history`` is an array of earlier replies; nulls in it never match.
    """
    size = F.char_length(reply)
    lower = F.lower(T.strip(reply))
    ok = (
        size.between(C.REPLY_MIN_CHARS, C.REPLY_MAX_CHARS)
        & ~_contains_any(lower, C.BANNED_PHRASES)
        & ~F.coalesce(T.same_text(reply, message), F.lit(False))
    )
    if history is not None:
        repeated = F.exists(history, lambda h: F.coalesce(F.lower(h) == lower, F.lit(False)))
        ok = ok & ~F.coalesce(repeated, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def template(
    label: Column,
    banks: Mapping[str, Sequence[str]],
    default: Sequence[str],
    session_id: Column | str,
    message: Column | str,
) -> Column:
    """Reproducible template for a label; ``default`` serves unknown labels.

    The banks are small constants, so they fold into the expression and need
    no join. Banks of one size share a single hash.
    """
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, options in banks.items():
        chosen = chosen.when(label == name, T.pick(_strings(options), len(options), session_id, message))
    return chosen.otherwise(T.pick(_strings(default), len(default), session_id, message))


def safety_reply(level: Column) -> Column:
    """Fixed reply of an elevated level; null for a normal one."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, reply in C.SAFETY_REPLIES.items():
        chosen = chosen.when(level == name, F.lit(reply))
    return chosen


def remap_label(label: Column, mapping: Mapping[str, str], default: str = "neutral") -> Column:
    """Project label of a model label; unknown or null becomes ``default``."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    lower = F.lower(label)
    for source, target in mapping.items():
        chosen = chosen.when(lower == source, F.lit(target))
    return chosen.otherwise(F.lit(default))
