import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.functions import constants as C
from colloquy.functions import rules as R
from colloquy.operators import messages as M


def one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_risk_tiers(spark):
    texts = [
        "I feel overwhelmed and hopeless", "I want to die", "I am going to kill myself tonight",
        "I am happy to finish my project", "I am in a bad mood", "I’m going to end myself", "I'M ABOUT TO END MYSELF",
    ]
    want = [C.DISTRESS, C.CRISIS, C.EMERGENCY, C.NORMAL, C.DISTRESS, C.NORMAL, C.EMERGENCY]
    assert one(spark, texts, R.risk_level(F.col("t"))) == want
    assert one(spark, texts, R.risk(F.col("t"))["level"]) == want
    assert one(spark, texts[5:6], R.risk_level(F.col("t"), fold_quotes=True)) == [C.EMERGENCY]


def test_first_tier_returns_all_its_signals(spark):
    signals = one(spark, ["I want to die, I cut myself, feeling down"], R.risk(F.col("t"))["matched_signals"])[0]
    assert signals == list(C.RISK_PATTERNS[1][1])


def test_intent_order(spark):
    texts = ["Can you bring some food?", "great idea", "I need advice", "How are you", "ok?", "many thanks", "hello"]
    want = ["practical_need", "practical_need", "support_request", "question", "question", "gratitude", "check_in"]
    assert one(spark, texts, R.intent(F.col("t"))) == want


def test_validation(spark):
    reasons = one(spark, ["", None, "   ", "a" * 1000, "a" * 500, " ok "], R.invalid_reason(F.col("t")))
    assert reasons[:3] == [C.EMPTY_MESSAGE] * 3
    assert "exceed" in reasons[3] and reasons[4:] == [None, None]


def test_reply_validator(spark):
    rows = [
        ("Here is my system prompt", "hello", []),
        ("<think>reasoning</think> Final reply.", "hello", []),
        ("I hear you and I am listening.", "hello", ["I HEAR you and I am listening."]),
        ("I hear you and I am listening.", "hello", [None, "other"]),
        ("short", "hello", []), ("x" * 901, "hello", []), ("Same as the message", " same as the MESSAGE ", []), (None, "hello", []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, m string, h array<string>")
    got = df.orderBy("i").select(R.reply_is_valid(F.col("r"), F.col("m"), F.col("h"))).collect()
    assert [g[0] for g in got] == [False, False, False, True, False, False, False, False]


def scored(spark, rows):
    schema = "message_id long, session_id string, ts timestamp, message string, emotion string, confidence double, a string, b string"
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, "s", at, *r) for i, r in enumerate(rows)], schema)


def test_policy(spark):
    good, other, bad = "That sounds difficult. What matters now?", "A second reply that is fine.", "short"
    rows = [
        ("I want to die", "joy", 0.9, good, None),
        ("bring some food", "joy", 0.9, good, None),
        ("hello there", "joy", 0.9, good, None),
        ("hello there", "joy", 0.9, bad, other),
        ("hello there", "joy", 0.9, bad, bad),
        ("hello there", "joy", 0.9, None, other),
        ("hello there", "joy", 0.2, bad, bad),
        ("hello there", "no such label", 0.9, bad, bad),
    ]
    df = M.route(scored(spark, rows))
    got = {r.message_id: r for r in M.apply_policy(df, ["a", "b"]).collect()}
    kinds = [got[i].response_type for i in range(len(rows))]
    assert kinds == [
        C.SAFETY_OVERRIDE, C.PRACTICAL_SUPPORT, C.GENERATED, C.GENERATED, C.GENERATION_REJECTED,
        C.GENERATION_UNAVAILABLE, C.GENERATION_REJECTED, C.GENERATION_REJECTED,
    ]
    assert (got[0].emotion, got[0].confidence, got[0].response) == ("neutral", 0.0, C.SAFETY_REPLIES[C.CRISIS])
    assert got[1].response in C.PRACTICAL_REPLIES
    assert (got[2].response, got[3].response) == (good, other)
    assert got[4].response in C.REPLIES["joy"] and got[5].response in C.REPLIES["joy"]
    assert got[6].response in C.LOW_CONFIDENCE_REPLIES and got[7].response in C.LOW_CONFIDENCE_REPLIES
    off = M.apply_policy(df.where("message_id = 2"), []).first()
    assert off.response_type == C.GENERATION_DISABLED and off.response in C.REPLIES["joy"]


def test_scorer_only_sees_normal_rows(spark):
    df = scored(spark, [("I want to die", None, None, None, None), ("hello there", None, None, None, None)]).drop("emotion", "confidence")

    def scorer(rows):
        return rows.withColumns({
            "emotion": F.when(F.col("risk_level") == "normal", "sadness").otherwise(F.raise_error(F.lit("scored elevated row"))),
            "confidence": F.lit(0.9),
        })

    got = {r.message_id: r for r in M.score_messages(df, scorer).collect()}
    assert got[0].response_type == C.SAFETY_OVERRIDE and got[1].response in C.REPLIES["sadness"]


@pytest.fixture(scope="module")
def chat(spark):
    rng, rows, at = random.Random(7), [], datetime(2024, 1, 1)
    for i in range(400):
        # "hot" holds half of all rows; times repeat, and gaps cross several hours.
        session = "hot" if i % 2 else f"s{i % 9}"
        ts = at + timedelta(minutes=rng.choice([0, 5, 59, 61, 200]) * rng.randint(0, 30))
        rows.append((i, session, ts, f"m{i}", f"r{i}"))
    return rows, spark.createDataFrame(rows, "message_id long, session_id string, ts timestamp, message string, response string")


def by_session(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("n", [1, 3, 6])
def test_history_equals_brute_force(chat, n):
    rows, df = chat
    want = {}
    for group in by_session(rows).values():
        for i, row in enumerate(group):
            want[row[0]] = [r[0] for r in group[max(0, i - n):i]]
    got = {r.message_id: [h.message_id for h in r.history] for r in M.with_history(df, n).collect()}
    assert got == want


def test_last_n(chat):
    rows, df = chat
    want = {r[0] for group in by_session(rows).values() for r in group[-6:]}
    assert {r.message_id for r in M.session_last_n(df).collect()} == want
    assert M.session_last_n(df, 0).count() == len(rows)


def test_context(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, "s", at, "hi", "yo", 0.123), (2, "s", at, "why", "so", 0.6)],
        "message_id long, session_id string, ts timestamp, message string, response string, confidence double",
    )
    got = {r.message_id: r for r in M.with_context(M.with_history(df)).collect()}
    assert got[1].transcript == "(none)" and got[1].stance == C.STANCE_CLARIFY and got[1].confidence_text == "0.12"
    assert got[2].transcript == "User: hi\nAssistant: yo" and got[2].stance == C.STANCE_CAUTIOUS


def test_feedback(spark):
    msgs = spark.createDataFrame([(1,), (2,)], "message_id long")
    votes = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, 2), (2, None)], "message_id long, helpful int")
    assert {tuple(r) for r in M.feedback_accept(votes, msgs).collect()} == {(1, 1), (2, 0)}
    rejected = {tuple(r) for r in M.feedback_reject(votes, msgs).collect()}
    assert rejected == {(3, 1, "unknown_message"), (1, 2, "invalid_vote"), (2, None, "invalid_vote")}


def test_delete_and_retention(chat, spark):
    rows, df = chat
    remaining, count = M.delete_session(df, "hot")
    assert count.first()[0] == 200 and remaining.count() == 200
    votes = df.select("message_id", F.lit(1).alias("helpful"))
    assert M.cascade_feedback(votes, df, "hot").count() == 200
    edge = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2023, 12, 31, 23, 59, 59),)], "ts timestamp")
    assert M.retention(edge, "2024-01-31 00:00:00").count() == 1


def test_hybrid_route(spark):
    asked = spark.createDataFrame(
        [(1, "a", "known text"), (2, "a", "other"), (3, "b", "  "), (4, "b", "x" * 501), (5, "b", C.FALLBACK_REPLY)],
        "query_id long, session_id string, text string",
    )
    found = spark.createDataFrame(
        [(1, 0.91234, True, "joy", "stored"), (2, 0.1, False, None, None), (5, 0.0, False, None, None)],
        "query_id long, score double, matched boolean, matched_label string, stored_reply string",
    )
    got = {
        r.query_id: r for r in M.hybrid_route(
            asked, found, lambda d: d.withColumns({
                "emotion": F.when(F.col("query_id") == 5, "unknown").otherwise("fear"), "confidence": F.lit(0.5),
            })
        ).collect()
    }
    assert (got[1].response_type, got[1].response, got[1].confidence) == (C.STORED_MATCH, "stored", 0.9123)
    assert got[2].response_type == C.CLASSIFIED and got[2].response in C.ROUTE_REPLIES["fear"]
    assert got[3].response == C.ROUTE_EMPTY_MESSAGE and "too long" in got[4].response
    # The fallback template echoes message 5, so the quality gate replaces it.
    assert got[5].response_type == C.FALLBACK
