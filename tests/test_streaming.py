from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages, sessions
from colloquy.plans.registry import QUERIES
from colloquy.streaming import jobs

AT = datetime(2024, 1, 1)
MESSAGE = "message_id long, session_id string, ts timestamp, message string, emotion string, confidence double"


def run(df, tmp_path, name):
    jobs.append_to(df, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


@pytest.fixture()
def chat(spark, tmp_path):
    texts = ["I want to die", "bring food", "hello", "", None, "x" * 501, "thanks"]
    rows = [(i, f"s{i % 3}", AT + timedelta(minutes=i), texts[i % 7], "joy", (i % 10) / 10) for i in range(70)]
    df = spark.createDataFrame(rows, MESSAGE)
    for part in range(2):
        df.where(F.col("message_id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
    return df, jobs.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)


def test_stream_equals_batch(chat, spark, tmp_path):
    df, stream = chat
    paths = [str(tmp_path / name) for name in ("scored", "rejected", "state")]
    jobs.score_to(stream, *paths).awaitTermination()
    want = messages.score_messages(df)
    got = {tuple(r) for r in spark.read.parquet(paths[0]).select(*want.columns).collect()}
    assert got == {tuple(r) for r in want.collect()}
    bad = {r.message_id for r in spark.read.parquet(paths[1]).collect()}
    assert bad == {i for i in range(70) if i % 7 in (3, 4, 5)} and len(got) + len(bad) == 70


def test_streamed_replies_are_checked_against_history(spark, tmp_path):
    said = "I hear you and I am listening."
    schema = MESSAGE + ", candidate_reply string, response string"
    rows = spark.createDataFrame([(2, "s", AT + timedelta(minutes=1), "hello", "joy", 0.9, said, said)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([(1, "s", AT, "hi", "joy", 0.9, said, said)], schema)
    for name, known, kind in (("with", stored, "ollama_validation_fallback"), ("without", stored.limit(0), "ollama_generated")):
        stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema)
        paths = [str(tmp_path / f"{name}-{x}") for x in ("scored", "rejected", "state")]
        jobs.score_to(stream, *paths, candidates=["candidate_reply"], stored=known).awaitTermination()
        assert [r.response_type for r in spark.read.parquet(paths[0]).collect()] == [kind]


def test_repeats_are_dropped(chat, spark, tmp_path):
    df, _ = chat
    df.limit(20).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    out = run(jobs.once_per_message(stream, "2 hours"), tmp_path, "once")
    assert out.count() == 70 and out.select("message_id").distinct().count() == 70


def test_partials_add_up_to_batch(spark, tmp_path):
    rows = [
        (i, f"u{i % 4}", AT + timedelta(hours=i), None if i % 7 == 0 else "abc"[i % 3], None if i % 7 == 0 else (i % 10) / 10)
        for i in range(24 * 6)
    ]
    schema = "event_id long, session_id string, ts timestamp, emotion string, confidence double"
    df = spark.createDataFrame(rows, schema)
    for day in range(0, 7):
        low = AT + timedelta(days=day)
        df.where((F.col("ts") >= low) & (F.col("ts") < low + timedelta(days=1 if day < 6 else 99))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema)
    partials = jobs.session_partials(stream)
    path = str(tmp_path / "partials")
    jobs.update_table(partials, path, str(tmp_path / "state")).awaitTermination()
    newest = jobs.latest(spark, path, partials.schema, ["day", "session_id", "emotion"])
    got = {tuple(r) for r in jobs.merge_partials(newest).collect()}
    real = df
    want = {
        tuple(r) for r in sessions.session_summary(real)
        .join(sessions.session_dominant(real).select("session_id", "dominant_emotion"), "session_id")
        .select("session_id", "n_messages", "mean_confidence", "uncertainty_rate", "dominant_emotion").collect()
    }
    assert got == want


def arrive(spark, folder, rows, schema, start):
    """Files one after another, each a batch of its own; the query is started again for each."""
    for part in rows:
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        start(jobs.read_stream(spark, str(folder), df.schema)).awaitTermination()


def test_a_repeat_weeks_later_is_stored_once(spark, tmp_path):
    schema = "message_id long, ts timestamp, message string"
    first = [(i, AT, "a") for i in range(10)] + [(3, AT, "a"), (None, AT, "n"), (None, AT, "n")]
    later = [(i, AT + timedelta(days=40), "b") for i in range(5, 15)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, tmp_path / "in", [first, later, later], schema, lambda s: jobs.append_new(s, out, state, buckets=4))
    rows = spark.read.schema(schema).parquet(out).collect()
    assert sorted(r.message_id for r in rows if r.message_id is not None) == list(range(15))
    assert {r.message for r in rows if r.message_id is not None and r.message_id < 10} == {"a"} and len(rows) == 17
    # The last batch runs again, as after a crash before its commit.
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    jobs.append_new(jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), out, state, buckets=4).awaitTermination()
    assert spark.read.schema(schema).parquet(out).count() == 17


def test_streamed_transitions_equal_batch(spark, tmp_path):
    rows = [
        (i, f"u{i % 3}" if i % 11 else None, AT + timedelta(hours=i), None if i % 7 == 0 else "abcd"[i * i % 4])
        for i in range(24 * 5)
    ]
    schema = "event_id long, session_id string, ts timestamp, emotion string"
    # Late rows: each batch holds rows of all days; one batch has no label at all.
    parts = [rows[k::3] for k in range(3)] + [[(999, "u0", AT, None)]]
    path, state = str(tmp_path / "moves"), str(tmp_path / "state")
    arrive(spark, tmp_path / "in", parts, schema, lambda s: jobs.transitions_table(s, path, state, fold_every=2))
    want = sessions.session_transitions(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in jobs.live_transitions(spark, path).collect()} == {tuple(r) for r in want.collect()}


def test_batches_are_folded(spark, tmp_path):
    schema = "event_id long, session_id string, ts timestamp, emotion string, confidence double"
    parts = [[(10 * b + i, f"u{i % 2}", AT + timedelta(minutes=b), "ab"[i % 2], 0.5) for i in range(10)] for b in range(5)]
    path, state, keys = str(tmp_path / "p"), str(tmp_path / "state"), ["day", "session_id", "emotion"]
    seen = []

    def start(stream):
        partials = jobs.session_partials(stream)
        seen.append(partials.schema)
        return jobs.update_table(partials, path, state, keys, fold_every=2)

    arrive(spark, tmp_path / "in", parts, schema, start)
    newest = jobs.latest(spark, path, seen[0], keys).collect()
    assert sorted((r.session_id, r.emotion, r.n) for r in newest) == [("u0", "a", 25), ("u1", "b", 25)]
    assert len(list((tmp_path / "p").glob("batch=*"))) <= 3 and len(list((tmp_path / "p" / "_folded").glob("upto=*"))) == 1


def test_running_totals(chat, spark):
    df, stream = chat
    query = jobs.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {
        tuple(r) for r in df.groupBy("session_id", "emotion").count().collect()
    }


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """Large tables are folders of files, not one file."""
    talk = spark.createDataFrame([(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"hello {i}") for i in range(80)],
                                 "conv_id long, turn long, role string, text string")
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 5, "view", float(i), '{"k": 1}') for i in range(50)],
                                   "event_id long, ts string, user_id long, event_type string, value double, props string")
    for name, df in (("conversations", talk), ("events", events)):
        df.repartition(3).write.parquet(str(tmp_path / "many" / f"{name}.parquet"))
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet", index=False)
    for name, least in (("stream_scoring", 1), ("stream_quarantine", 1), ("stream_once_per_message", 50)):
        one, many = ({tuple(r) for r in QUERIES[name](spark, str(d)).collect()} for d in (tmp_path, tmp_path / "many"))
        assert one == many and len(many) >= least
