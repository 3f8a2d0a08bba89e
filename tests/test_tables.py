import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages, split
from colloquy.session import materialize, scratch_path, shared_dir
from colloquy.sources import tables


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text('user_input,emotion_label,bot_response\n"a, ""b""\nc",joy,ok\n,fear,"x"\n', encoding="utf-8")
    df = tables.require_columns(tables.read_corpus(spark, str(path)))
    assert {tuple(r) for r in df.collect()} == {('a, "b"\nc', "joy", "ok"), (None, "fear", "x")}
    with pytest.raises(ValueError):
        tables.require_columns(df.drop("bot_response"))


def test_split_round_trip(spark, tmp_path):
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    out = split.group_split(df).drop("text_key")
    tables.write_split(out, str(tmp_path / "split"))
    back = tables.read_table(spark, str(tmp_path / "split"))
    assert {tuple(r) for r in back.select(*out.columns).collect()} == {tuple(r) for r in out.collect()}
    held = back.where(F.col("split") == "evaluation")
    assert "PartitionFilters: [isnotnull(split" in held._jdf.queryExecution().executedPlan().toString()


def log_rows(spark):
    routed = spark.createDataFrame(
        [("s", "hello", 0.5, "joy", 0.7, "faq_match"), ("s", None, None, None, None, "validation_error")],
        "session_id string, text string, similarity double, emotion string, confidence double, response_type string",
    )
    return messages.to_log(routed, F.lit(datetime(2024, 1, 1)), F.lit(0.00123456))


def test_log_append(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(log_rows(spark), path)
    tables.append_log(log_rows(spark), path)
    back = tables.read_table(spark, path, tables.LOG)
    assert back.count() == 4
    assert {r.input_length for r in back.collect()} == {0, 5} and back.first().latency_seconds == 0.0012


def test_message_store_prunes_by_day(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = [(i, "s", "m", "r", datetime(2024, 1, 1 + i), "joy", 0.5, "check_in", "normal", "x", "v", 1.0) for i in range(3)]
    tables.append_messages(spark.createDataFrame(rows, tables.MESSAGES), path)
    store = tables.read_table(spark, path)
    kept = messages.retention(store, "2024-02-01 12:00:00", days=30, ts="timestamp")
    assert [r.message_id for r in kept.collect()] == [2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    one = messages.session_messages(store.withColumnRenamed("timestamp", "ts"), "s")
    assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,s)]" in one._jdf.queryExecution().executedPlan().toString()


def test_metrics_document_and_threshold(spark, tmp_path):
    path = tmp_path / "faq.json"
    path.write_text(json.dumps({"chosen_thresholds": {"tfidf": {"threshold": 0.75}, "other": None}}, indent=2))
    assert tables.chosen_threshold(spark, str(path), "tfidf") == 0.75
    assert tables.chosen_threshold(spark, str(path), "other") == 0.6
    assert tables.chosen_threshold(spark, str(path), "absent") == 0.6
    assert tables.chosen_threshold(spark, str(tmp_path / "no.json"), "tfidf") == 0.6
    nested = spark.range(1).select(F.map_from_arrays(F.array(F.lit("0.6")), F.array(F.struct(F.lit(1).alias("n")))).alias("sweep"))
    tables.write_document(nested, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"sweep":{"0.6":{"n":1}}}'


class Configured:
    """A session as far as the folder lookup is concerned."""

    def __init__(self, value):
        self.conf = self
        self.value = value

    def get(self, key, default):
        return self.value if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(Configured("/shared/x")) == "/shared/x"
    assert scratch_path(Configured("/shared/x/"), "t").startswith("/shared/x/t-")
    # Unset, as here in the tests: one temporary folder per session.
    assert shared_dir(spark) == shared_dir(spark) and materialize(spark.range(5), "t").count() == 5


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text('bot_response,user_input,emotion_label\n"a, b",hello,joy\n')
    row = tables.read_corpus(spark, str(path)).first()
    assert (row.user_input, row.emotion_label, row.bot_response) == ("hello", "joy", "a, b")
    path.write_text("bot_response,user_input\nx,y\n")
    with pytest.raises(ValueError):
        tables.read_corpus(spark, str(path))


def test_rewrite_counts_what_it_leaves_out(spark, tmp_path):
    rows = spark.range(10).selectExpr("id message_id", "concat('s', id % 2) session_id", "timestamp'2024-01-01' timestamp")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.MESSAGES.fields])
    tables.append_messages(full, str(tmp_path / "old"))
    gone = tables.rewrite_where(spark, str(tmp_path / "old"), str(tmp_path / "new"), F.col("session_id") != "s1", tables.MESSAGES)
    assert gone == 5 and tables.read_table(spark, str(tmp_path / "new"), tables.MESSAGES).count() == 5
    assert "dt" not in tables.MESSAGES.fieldNames()


@pytest.fixture()
def by_day(spark, tmp_path):
    """Forty rows over four days and without a time; session ``s1`` on days 2 and 3, all of day 3."""
    path = str(tmp_path / "messages")
    rows = spark.range(40).selectExpr(
        "id message_id", "case when id % 5 = 2 then 's1' when id % 5 = 1 and id % 2 = 0 then 's1' else 's0' end session_id",
        "case when id % 5 < 4 then timestamp'2024-01-01 10:00:00' + make_dt_interval(id % 5) + make_dt_interval(0, id div 10) end timestamp",
    )
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.MESSAGES.fields])
    tables.append_messages(full, path)
    return path, [tuple(r) for r in rows.collect()]


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("dt=*/*.parquet")}


def ids(spark, path):
    return {r.message_id for r in tables.read_table(spark, path, tables.MESSAGES).collect()}


def test_delete_touches_only_the_days_that_hold_the_session(spark, by_day):
    path, rows = by_day
    before = files(path)
    gone = tables.delete_where(spark, path, F.col("session_id") == "s1", tables.MESSAGES)
    assert gone == sum(r[1] == "s1" for r in rows) and ids(spark, path) == {r[0] for r in rows if r[1] != "s1"}
    after = files(path)
    same = [f for f in before if "dt=2024-01-02" not in f and "dt=2024-01-03" not in f]
    assert same and all(before[f] == after[f] for f in same)
    assert not [f for f in after if "dt=2024-01-03" in f] and not list(Path(path, "_staged").iterdir())
    assert tables.delete_where(spark, path, F.col("session_id") == "s1", tables.MESSAGES) == 0 and files(path) == after


def test_delete_rows_without_a_day(spark, by_day):
    path, rows = by_day
    gone = tables.delete_where(spark, path, F.col("timestamp").isNull() & (F.col("message_id") < 20), tables.MESSAGES)
    assert gone == 4 and ids(spark, path) == {r[0] for r in rows if r[2] or r[0] >= 20}


def test_retention_drops_old_days_and_keeps_new_files(spark, by_day):
    path, rows = by_day
    before, cutoff = files(path), datetime(2024, 1, 2, 12)
    gone = tables.drop_days_before(spark, path, cutoff, tables.MESSAGES)
    kept = {r[0] for r in rows if r[2] is None or r[2] >= cutoff}
    assert ids(spark, path) == kept and gone == len(rows) - len(kept)
    same = [f for f in before if "dt=2024-01-01" not in f and "dt=2024-01-02" not in f]
    assert same and all(before[f] == files(path)[f] for f in same) and not Path(path, "dt=2024-01-01").exists()


def test_interrupted_deletion_is_thrown_away_or_completed(spark, by_day, monkeypatch):
    path, rows = by_day
    # Staged to the end, but not put in place: readers see the old table, the next call completes it.
    with monkeypatch.context() as patched:
        calls = []
        real = tables.finish_rewrites
        patched.setattr(tables, "finish_rewrites", lambda *a: calls.append(a) or (real(*a) if len(calls) == 1 else None))
        tables.delete_where(spark, path, F.col("session_id") == "s1", tables.MESSAGES)
    assert len(ids(spark, path)) == 40
    # Staged half-way: thrown away.
    spark.createDataFrame([], tables.MESSAGES).write.parquet(f"{path}/_staged/half/rows")
    tables.finish_rewrites(spark, path, tables.MESSAGES)
    assert ids(spark, path) == {r[0] for r in rows if r[1] != "s1"} and not list(Path(path, "_staged").iterdir())


def test_no_local_folder_on_a_cluster():
    class Far:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        shared_dir(Far())
