from collections import Counter
from datetime import datetime, timedelta

import pytest

from colloquy.operators import frames, messages
from colloquy.operators import sessions as S

AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        # a -> null -> b counts as a -> b, also across hours.
        (1, "u1", AT, "a", 0.2, "classifier_generated"),
        (2, "u1", AT + timedelta(hours=1), None, None, "validation_error"),
        (3, "u1", AT + timedelta(hours=9), "b", 0.9, "faq_match"),
        # Same time: the id decides. Tied counts: the label seen first wins.
        (5, "u2", AT, "z", 0.5, "classifier_generated"),
        (4, "u2", AT, "y", 0.1, "safety_override"),
        # No labels and no confidences at all.
        (6, "u3", AT, None, None, "validation_error"),
    ]
    schema = "event_id long, session_id string, ts timestamp, emotion string, confidence double, response_type string"
    return spark.createDataFrame(rows, schema)


def test_transitions_skip_nulls_and_cross_hours(log):
    got = {tuple(r) for r in S.emotion_transitions(log).collect()}
    assert got == {("a", "b", 1), ("y", "z", 1)}


def test_dominant_tie_goes_to_first_seen(log):
    got = {r.session_id: r.dominant_emotion for r in S.session_dominant(log).collect()}
    assert got == {"u1": "a", "u2": "y"}


def test_summary(log):
    got = {r.session_id: tuple(r)[1:] for r in S.session_summary(log).collect()}
    assert got == {"u1": (3, 0.55, 0.5), "u2": (2, 0.3, 0.5), "u3": (1, None, 0.0)}
    without = {r.session_id: tuple(r)[1:] for r in S.session_summary(log, exclude_overrides=True).collect()}
    assert without["u2"] == (2, 0.5, 0.0)


def test_report_has_label_map(log):
    got = {r.session_id: r for r in S.session_report(log).collect()}
    assert got["u1"].emotion_distribution == {"a": 1, "b": 1} and got["u3"].emotion_distribution is None


def test_one_huge_session(spark):
    labels = "abc"
    rows = [(i, "hot", AT + timedelta(minutes=i // 3), labels[(i * i) % 3]) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, ts timestamp, emotion string")
    names = [r[3] for r in rows]
    assert {tuple(r) for r in S.emotion_transitions(df).collect()} == {
        (a, b, n) for (a, b), n in Counter(zip(names, names[1:])).items()
    }


@pytest.mark.parametrize("step", [timedelta(0), timedelta(days=36)], ids=["one moment", "a century"])
def test_hot_session_is_spread_by_rows(spark, step):
    said = [(i, "hot" if i % 10 else [None, "b", "zz"][i // 10 % 3], AT + step * i, f"m{i}", f"r{i}") for i in range(1000)]
    df = spark.createDataFrame(said, "message_id long, session_id string, ts timestamp, message string, response string")
    cut = frames.with_carry(df, ["session_id"], ["ts", "message_id"], 3, parts=8).where("not _carried").groupBy("_chunk").count()
    sizes = [r["count"] for r in cut.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 1000 / 8
    got = {r.message_id: [h.message_id for h in r.history] for r in messages.with_history(df, 3, parts=8).collect()}
    own = {}
    for i, session, *_ in said:
        assert got[i] == own.setdefault(session, [])[-3:]
        own[session].append(i)
    assert len(got) == 1000


def test_history_longer_than_a_range(spark):
    df = spark.range(40).selectExpr(
        "id message_id", "'s' session_id", "timestamp'2024-01-01' ts", "string(id) message", "string(id) response")
    got = {r.message_id: len(r.history) for r in messages.with_history(df, 12, parts=20).collect()}
    assert got == {i: min(i, 12) for i in range(40)}


def test_empty_log(log):
    none = log.where("false")
    assert S.emotion_transitions(none).count() == 0
    assert S.log_volume(none).first().messages == 0
    assert S.label_shares(none, "emotion").count() == 0
    assert S.routing_rates(none.withColumn("similarity", none.confidence)).first().n == 0
