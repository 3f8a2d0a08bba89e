"""Every query by name: ``(spark, sf_dir) -> DataFrame``.

Queries run over whole tables. Arrays and timestamps are shown as text so that
results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import constants as C
from colloquy.functions import rules as R
from colloquy.functions import text as T
from colloquy.operators import audit, evaluate, frames, linear, messages, models, sessions, similarity, split
from colloquy.session import materialize, scratch_path, shared_dir, shuffles_removed
from colloquy.sources import artifacts, tables
from colloquy.sources import derived as D
from colloquy.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SESSION_SHOWN = "s3"
CLOCK = "2024-02-05 00:00:00"
MATCH_THRESHOLD = 0.6
AUDITED = ["text", "label"]
T_SPLIT = "doc_id long, text string, label string, split string"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def shown(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(ts)


# --- Scans -----------------------------------------------------------------------------------

@query
def corpus_scan(spark, sf):
    quality = D.load(spark, sf, "labels").select("doc_id", "quality")
    return D.corpus_clean(spark, sf).join(quality, "doc_id", "left").select("doc_id", "text", "label", "quality")


@query
def log_scan(spark, sf):
    return D.log(spark, sf).withColumn("ts", shown())


@query
def session_messages(spark, sf):
    rows = messages.session_messages(D.msgs(spark, sf), SESSION_SHOWN)
    return rows.select("message_id", "session_id", shown(), "message", "response")


# --- Text ------------------------------------------------------------------------------------

@query
def normalize_text(spark, sf):
    return D.corpus_clean(spark, sf).select("doc_id", T.normalize("text").alias("normalized"))


@query
def normalize_text_strict(spark, sf):
    return D.corpus_clean(spark, sf).select("doc_id", T.normalize_strict("text").alias("normalized"))


@query
def audit_tokens(spark, sf):
    return D.corpus_clean(spark, sf).select("doc_id", F.array_join(T.audit_tokens("text"), " ").alias("tokens"))


@query
def text_lengths(spark, sf):
    return audit.text_lengths(D.corpus_clean(spark, sf)).select("doc_id", "char_count", "word_count", "punct_count")


@query
def model_ngrams(spark, sf):
    return D.load(spark, sf, "benchmark").select(
        "item_id", F.array_join(T.ngrams_1_2(T.model_tokens("text")), "|").alias("ngrams")
    )


@query
def token_sets(spark, sf):
    return D.load(spark, sf, "benchmark").select(
        "item_id", F.array_join(F.array_sort(T.token_set("text")), " ").alias("tokens")
    )


@query
def template_pick(spark, sf):
    rows = messages.accepted(messages.validate_messages(D.msgs(spark, sf)))
    key = F.concat("session_id", F.lit(":"), "message")
    return rows.select(
        "message_id", T.hash_mod(key, 2).alias("pick_of_2"), T.hash_mod(key, 7).alias("pick_of_7"),
        R.template(F.col("emotion"), C.REPLIES, C.LOW_CONFIDENCE_REPLIES, "session_id", "message").alias("reply"),
    )


@query
def quality_gate(spark, sf):
    return D.msgs(spark, sf).where(~T.is_blank("message")).select(
        "message_id", T.passes_quality_gate("response", "message").alias("passes")
    )


@query
def strip_think(spark, sf):
    return D.msgs(spark, sf).select("message_id", T.strip_reasoning("candidate_reply").alias("clean_reply"))


@query
def repeated_tail(spark, sf):
    rows = D.replies(spark, sf).withColumn("parts", T.sentences("text")).withColumn("run", T.tail_run(F.col("parts")))
    return rows.select(
        "doc_id", "run", (F.col("run") >= 2).alias("is_repeated"),
        T.repaired_tail(F.col("parts"), F.col("run")).alias("repaired"),
    )


# --- Messages --------------------------------------------------------------------------------

def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return messages.accepted(messages.validate_messages(D.msgs(spark, sf)))


@query
def validate_messages(spark, sf):
    return messages.validate_messages(D.msgs(spark, sf)).select("message_id", "reason", "clean_message")


@query
def safety_routing(spark, sf):
    return _accepted(spark, sf).withColumn("risk", R.risk(F.col("message"))).select(
        "message_id", F.col("risk.level").alias("level"),
        F.array_join("risk.matched_signals", " & ").alias("signals"),
    )


@query
def safety_routing_folded_quotes(spark, sf):
    return _accepted(spark, sf).select(
        "message_id", R.risk_level(F.col("message"), fold_quotes=True).alias("level")
    )


@query
def detect_intent(spark, sf):
    return _accepted(spark, sf).select("message_id", R.intent(F.col("message")).alias("intent"))


@query
def reply_validation(spark, sf):
    rows = messages.with_history(_accepted(spark, sf)).where(F.col("candidate_reply").isNotNull())
    return messages.check_replies(rows).select("message_id", "reply_valid")


@query
def confidence_tiers(spark, sf):
    return D.log(spark, sf).groupBy(R.stance(F.col("confidence")).alias("stance")).agg(F.count(F.lit(1)).alias("n"))


@query
def response_policy(spark, sf):
    return messages.score_messages(D.msgs(spark, sf), candidates=["candidate_reply"]).select(
        "message_id", "risk_level", "intent", "response_type", "emotion",
        F.round("confidence", 4).alias("confidence"), "response",
    )


@query
def response_policy_templates_only(spark, sf):
    return messages.score_messages(D.msgs(spark, sf)).select("message_id", "response_type", "response")


@query
def session_context(spark, sf):
    rows = messages.with_context(messages.with_history(_accepted(spark, sf)))
    return rows.select("message_id", "transcript", "stance", "confidence_text", "emotion")


@query
def stored_messages(spark, sf):
    """Message-table rows, written below the shared folder by day and read back."""
    scored = messages.score_messages(D.msgs(spark, sf), candidates=["candidate_reply"])
    path = scratch_path(spark, "messages")
    tables.append_messages(messages.stored_messages(scored, "v1", F.length("message") / 10), path)
    rows = tables.read_table(spark, path, tables.MESSAGES).drop("dt")
    return rows.withColumn("timestamp", shown("timestamp")).withColumn("confidence", F.round("confidence", 4))


@query
def label_remap(spark, sf):
    mapping = {"click": "joy", "view": "surprise", "purchase": "joy", "fear": "fear"}
    return (
        D.log(spark, sf).groupBy(R.remap_label(F.upper("emotion"), mapping).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def session_last_n(spark, sf):
    return messages.session_last_n(D.msgs(spark, sf)).select("session_id", "message_id", shown())


@query
def message_history(spark, sf):
    rows = messages.with_history(_accepted(spark, sf))
    ids = F.transform("history", lambda h: h["message_id"].cast("string"))
    return rows.select("message_id", "session_id", F.array_join(ids, ",").alias("history_ids"))


@query
def feedback_accept(spark, sf):
    return messages.feedback_accept(D.feedback(spark, sf), D.msgs(spark, sf))


@query
def feedback_reject(spark, sf):
    return messages.feedback_reject(D.feedback(spark, sf), D.msgs(spark, sf))


@query
def delete_session(spark, sf):
    remaining, _ = messages.delete_session(D.msgs(spark, sf), SESSION_SHOWN)
    return remaining.select("message_id", "session_id")


@query
def delete_session_count(spark, sf):
    return messages.delete_session(D.msgs(spark, sf), SESSION_SHOWN)[1]


@query
def delete_session_cascade(spark, sf):
    return messages.cascade_feedback(D.feedback(spark, sf), D.msgs(spark, sf), SESSION_SHOWN)


@query
def retention(spark, sf):
    return messages.retention(D.load(spark, sf, "events"), CLOCK).select("event_id", shown())


# --- Audit -----------------------------------------------------------------------------------

@query
def missing_and_blank(spark, sf):
    return audit.missing_and_blank(D.msgs(spark, sf), ["message", "candidate_reply", "session_id"])


@query
def missing_and_blank_documents(spark, sf):
    return audit.missing_and_blank(D.documents(spark, sf), ["text", "lang", "source"])


@query
def duplicate_counts(spark, sf):
    return audit.duplicate_counts(D.corpus_noisy(spark, sf), AUDITED)


@query
def label_conflicts(spark, sf):
    return audit.label_conflicts(D.corpus_noisy(spark, sf))


@query
def conflict_examples(spark, sf):
    return audit.conflict_examples(D.corpus_noisy(spark, sf)).select("doc_id", "label")


@query
def class_distribution(spark, sf):
    return audit.class_distribution(D.corpus_clean(spark, sf))


@query
def describe_lengths(spark, sf):
    return audit.describe_lengths(D.corpus_clean(spark, sf))


@query
def describe_by_label(spark, sf):
    return audit.describe_lengths(D.corpus_clean(spark, sf), ["label"])


@query
def token_frequency(spark, sf):
    return audit.token_frequency(D.corpus_clean(spark, sf))


@query
def vocab_stats(spark, sf):
    return audit.vocab_stats(D.corpus_clean(spark, sf))


@query
def top_tokens(spark, sf):
    return audit.top_tokens(D.corpus_clean(spark, sf))


@query
def punct_share(spark, sf):
    return audit.punct_share(D.corpus_clean(spark, sf))


@query
def length_outliers(spark, sf):
    return audit.length_outliers(D.corpus_clean(spark, sf))


@query
def length_outlier_examples(spark, sf):
    return audit.length_outlier_examples(D.corpus_clean(spark, sf))


@query
def length_histogram(spark, sf):
    return audit.length_histogram(D.corpus_clean(spark, sf))


@query
def char_length_histogram(spark, sf):
    return audit.length_histogram(D.corpus_clean(spark, sf), "char_count")


@query
def box_stats(spark, sf):
    return audit.box_stats(D.corpus_clean(spark, sf))


@query
def label_set_diff(spark, sf):
    return audit.label_set_diff(D.corpus_noisy(spark, sf))


@query
def validate_corpus(spark, sf):
    return audit.validate_corpus(D.corpus_noisy(spark, sf), ["text", "label", "source"])


# --- Splits ----------------------------------------------------------------------------------

@query
def group_split(spark, sf):
    return split.group_split(D.corpus_clean(spark, sf)).select("doc_id", "label", "split")


@query
def group_split_noisy(spark, sf):
    return split.group_split(D.corpus_noisy(spark, sf)).select("doc_id", "label", "split")


@query
def split_overlap(spark, sf):
    return split.split_overlap(split.group_split(D.corpus_clean(spark, sf)))


@query
def split_membership(spark, sf):
    corpus = D.corpus_clean(spark, sf)
    held = split.group_split(corpus).where("split = 'evaluation'").select("text_key").distinct()
    return split.rows_on_side(corpus, held).select("doc_id")


@query
def split_distribution(spark, sf):
    return split.split_distribution(split.group_split(D.corpus_clean(spark, sf)))


@query
def stratified_folds(spark, sf):
    return split.stratified_folds(D.corpus_clean(spark, sf)).select("doc_id", "label", "fold")


@query
def row_split(spark, sf):
    return split.row_split(D.corpus_clean(spark, sf)).select("doc_id", "label", "split")


# --- Evaluation ------------------------------------------------------------------------------

@query
def error_by_length(spark, sf):
    return evaluate.error_by_length(D.preds(spark, sf))


@query
def error_examples(spark, sf):
    return evaluate.error_examples(D.preds(spark, sf))


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(D.preds(spark, sf))


@query
def confused_pairs(spark, sf):
    return evaluate.confused_pairs(D.preds(spark, sf))


@query
def per_class_report(spark, sf):
    return evaluate.per_class_report(D.preds(spark, sf))


@query
def overall_metrics(spark, sf):
    return evaluate.overall_metrics(D.preds(spark, sf))


@query
def imbalance_report(spark, sf):
    return evaluate.imbalance_report(D.preds(spark, sf))


# --- Sessions --------------------------------------------------------------------------------

@query
def log_volume(spark, sf):
    return sessions.log_volume(D.log(spark, sf))


@query
def emotion_distribution(spark, sf):
    return sessions.label_shares(D.log(spark, sf), "emotion")


@query
def response_type_share(spark, sf):
    return sessions.label_shares(D.log(spark, sf), "response_type")


@query
def routing_rates(spark, sf):
    return sessions.routing_rates(D.log(spark, sf))


@query
def describe_log(spark, sf):
    return frames.describe(D.log(spark, sf), [], ["latency_seconds", "confidence", "input_length"], continuous=True)


@query
def confidence_by_type(spark, sf):
    return sessions.confidence_by_type(D.log(spark, sf))


@query
def latency_histogram(spark, sf):
    return frames.histogram(D.log(spark, sf), "latency_seconds", 20)


@query
def emotion_transitions(spark, sf):
    return sessions.emotion_transitions(D.log(spark, sf))


@query
def session_summary(spark, sf):
    return sessions.session_summary(D.log(spark, sf))


@query
def session_dominant(spark, sf):
    return sessions.session_dominant(D.log(spark, sf))


@query
def session_label_counts(spark, sf):
    return sessions.session_labels(D.log(spark, sf)).select(
        "session_id", "emotion", "n", F.col("first_seen.event_id").alias("first_event")
    )


@query
def session_transitions(spark, sf):
    return sessions.session_transitions(D.log(spark, sf))


@query
def session_report(spark, sf):
    """Summary, dominant label, label map, transitions and timeline of one session."""
    rows = sessions.session_detail(D.log(spark, sf), "u3")
    return rows.withColumns({c: F.to_json(c) for c in ("emotion_distribution", "transitions", "timeline")})


@query
def session_timeline(spark, sf):
    return sessions.session_timeline(D.log(spark, sf)).withColumn("ts", shown())


# --- Similarity ------------------------------------------------------------------------------

def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return D.bank_queries(spark, sf), D.bank(spark, sf)


@query
def tfidf_weights(spark, sf):
    return similarity.tfidf_weights(D.bank(spark, sf)).withColumn("w", F.round("w", 4))


@query
def tfidf_cosine_top1(spark, sf):
    scored = similarity.tfidf_best(*_sides(spark, sf))
    return scored.select("query_id", "bank_pos", F.round("score", 4).alias("score"))


@query
def jaccard_top1(spark, sf):
    scored = similarity.jaccard_best(*_sides(spark, sf))
    return scored.select("query_id", "bank_pos", F.round("score", 4).alias("score"))


@query
def char_similarity_top1(spark, sf):
    scored = similarity.char_best(*_sides(spark, sf))
    return scored.select("query_id", "bank_pos", F.round("score", 4).alias("score"))


@query
def best_match(spark, sf):
    asked, stored = _sides(spark, sf)
    found = similarity.best_match(similarity.tfidf_best(asked, stored), stored, MATCH_THRESHOLD)
    return found.select("query_id", F.round("score", 4).alias("score"), "matched", "matched_label", "stored_reply")


@query
def threshold_sweep(spark, sf):
    asked, stored = _sides(spark, sf)
    return similarity.threshold_sweep(similarity.tfidf_best(asked, stored), stored)


@query
def threshold_sweep_jaccard(spark, sf):
    asked, stored = _sides(spark, sf)
    return similarity.threshold_sweep(similarity.jaccard_best(asked, stored), stored)


@query
def threshold_sweep_char(spark, sf):
    asked, stored = _sides(spark, sf)
    return similarity.threshold_sweep(similarity.char_best(asked, stored), stored)


@query
def best_score_stats(spark, sf):
    return similarity.best_score_stats(similarity.tfidf_best(*_sides(spark, sf)))


@query
def best_score_stats_jaccard(spark, sf):
    return similarity.best_score_stats(similarity.jaccard_best(*_sides(spark, sf)))


@query
def best_score_stats_char(spark, sf):
    return similarity.best_score_stats(similarity.char_best(*_sides(spark, sf)))


@query
def threshold_choice(spark, sf):
    return similarity.choose_threshold(threshold_sweep(spark, sf))


@query
def threshold_choice_jaccard(spark, sf):
    return similarity.choose_threshold(threshold_sweep_jaccard(spark, sf))


@query
def threshold_choice_char(spark, sf):
    return similarity.choose_threshold(threshold_sweep_char(spark, sf))


@query
def hybrid_route(spark, sf):
    asked, stored = _sides(spark, sf)
    return _routed(asked, _router(spark, stored))


def _router(spark: SparkSession, stored: DataFrame) -> dict[str, DataFrame]:
    """Bank, index and model as one published version; made anew only where the bank has changed."""
    stored = materialize(stored, "bank")

    def make() -> dict[str, DataFrame]:
        model = linear.fit(stored, row_id="bank_pos")
        return {"bank": stored, **artifacts.index_tables(similarity.tfidf_index(stored)), **artifacts.model_tables(model)}

    return artifacts.ensure(spark, f"{shared_dir(spark).rstrip('/')}/router", artifacts.fingerprint(stored), make)


def _routed(asked: DataFrame, router: dict[str, DataFrame]) -> DataFrame:
    stored = router["bank"]
    best = similarity.tfidf_best(asked, stored, artifacts.index_of(router))
    found = similarity.best_match(best, stored, MATCH_THRESHOLD)
    rows = asked.withColumn("session_id", F.concat(F.lit("q"), "query_id"))
    return messages.hybrid_route(rows, found, linear.scorer(artifacts.model_of(router), "query_id", "text"))


@query
def saved_model_route(spark, sf):
    """Index and model are published twice and the newest version is loaded, then routes all questions."""
    asked, stored = _sides(spark, sf)
    path = scratch_path(spark, "artifact")
    made = _router(spark, stored)
    artifacts.publish(spark, path, {"bank": stored.limit(0)}, "old")
    artifacts.publish(spark, path, made, "new")
    return _routed(asked, artifacts.load(spark, path))


# --- Models ----------------------------------------------------------------------------------

def _train_and_eval(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of the split, stored once for the passes of one query."""
    path = scratch_path(spark, "split")
    with shuffles_removed(spark):
        tables.write_split(split.group_split(D.corpus_clean(spark, sf)).drop("text_key"), path)
    sides = tables.read_table(spark, path, T_SPLIT)
    return sides.where("split = 'train'"), sides.where("split = 'evaluation'")


def _held_out(spark: SparkSession, sf: str, name: str, steps: int | None = None) -> DataFrame:
    train, held = _train_and_eval(spark, sf)
    return linear.predict(linear.fit(train, name, steps=steps), held)


@query
def train_logreg(spark, sf):
    return evaluate.overall_metrics(_held_out(spark, sf, models.LOGREG))


@query
def train_svm(spark, sf):
    return evaluate.overall_metrics(_held_out(spark, sf, models.SVM))


@query
def train_nb(spark, sf):
    return evaluate.overall_metrics(_held_out(spark, sf, models.BAYES))


@query
def predict_nb(spark, sf):
    return _held_out(spark, sf, models.BAYES).select("doc_id", "pred", F.round("confidence", 4).alias("confidence"))


@query
def predict_logreg(spark, sf):
    return _held_out(spark, sf, models.LOGREG, linear.STEPS).select("doc_id", "pred", F.round("confidence", 4).alias("confidence"))


@query
def score_confidence(spark, sf):
    scored = _held_out(spark, sf, models.SVM, linear.STEPS)
    return scored.select("doc_id", "label", "pred", F.round("confidence", 4).alias("confidence"))


def _shown_folds(summary: DataFrame) -> DataFrame:
    shown_scores = F.transform("fold_scores", lambda x: F.format_string("%.4f", x))
    return summary.withColumn("fold_scores", F.array_join(shown_scores, ","))


def _cross_validated(spark: SparkSession, sf: str, steps: int | None = linear.STEPS) -> DataFrame:
    return evaluate.cv_summary(linear.cross_validate(_train_and_eval(spark, sf)[0], steps=steps))


@query
def cv_summary(spark, sf):
    """Three models in five folds of the training side."""
    return _shown_folds(_cross_validated(spark, sf))


@query
def holdout_eval(spark, sf):
    """Cross-validate, choose the best model, and judge it on rows no fit has seen."""
    train, held = _train_and_eval(spark, sf)
    name = models.best_name(evaluate.cv_summary(linear.cross_validate(train, steps=linear.STEPS)))
    return evaluate.overall_metrics(linear.predict(linear.fit(train, name, steps=linear.STEPS), held)).withColumn("model", F.lit(name))


@query
def model_selection(spark, sf):
    return evaluate.select_model(_cross_validated(spark, sf))


@query
def model_comparison(spark, sf):
    """Three models in five folds of the training side, each fitted until it converges."""
    return evaluate.comparison_table(_cross_validated(spark, sf, steps=None), None, "Fine-tuned transformer")


def _fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of two stand-in models, which err on different documents, in five folds."""
    rows = D.preds(spark, sf).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    first = rows.withColumn("model", F.lit("first"))
    second = rows.withColumn("model", F.lit("second")).withColumn(
        "pred", F.when(F.col("doc_id") % 13 == 0, "de").otherwise(F.col("label"))
    )
    return evaluate.overall_metrics(first.unionByName(second), ["model", "fold"], digits=None)


@query
def fold_summary(spark, sf):
    return _shown_folds(evaluate.cv_summary(_fold_metrics(spark, sf)))


@query
def model_selection_stand_in(spark, sf):
    return evaluate.select_model(evaluate.cv_summary(_fold_metrics(spark, sf)))


@query
def model_comparison_stand_in(spark, sf):
    return evaluate.comparison_table(evaluate.cv_summary(_fold_metrics(spark, sf)), None, "Fine-tuned transformer")


@query
def model_comparison_held_out(spark, sf):
    held = evaluate.overall_metrics(D.preds(spark, sf)).withColumn("model", F.lit("chosen"))
    return evaluate.comparison_table(evaluate.cv_summary(_fold_metrics(spark, sf)), held, None)


# --- Streams ---------------------------------------------------------------------------------

def _table_stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table as a stream. It may be one file or a folder of them: for a pattern Spark asks for no base folder."""
    return jobs.read_stream(spark, f"{sf}/{table}.parque[t]", D.load(spark, sf, table).schema)


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = _table_stream(spark, sf, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).select(*D.log_columns())


def _run(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    jobs.append_to(df, out, state).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _score_messages_stream(spark: SparkSession, sf: str) -> tuple[str, str]:
    turns = _table_stream(spark, sf, "conversations").where(F.col("role") == "user")
    scored, rejected = scratch_path(spark, "scored"), scratch_path(spark, "rejected")
    jobs.score_to(turns.select(*D.message_columns()), scored, rejected, scratch_path(spark, "state")).awaitTermination()
    return scored, rejected


@query
def stream_scoring(spark, sf):
    scored, _ = _score_messages_stream(spark, sf)
    return tables.read_table(spark, scored).select("message_id", "response_type", "response")


@query
def stream_quarantine(spark, sf):
    _, rejected = _score_messages_stream(spark, sf)
    return tables.read_table(spark, rejected).select("message_id", "reason")


def _partials(spark: SparkSession, sf: str) -> DataFrame:
    partials = jobs.session_partials(_events_stream(spark, sf))
    path = scratch_path(spark, "partials")
    jobs.update_table(partials, path, scratch_path(spark, "partials-state")).awaitTermination()
    return jobs.latest(spark, path, partials.schema, ["day", "session_id", "emotion"])


@query
def stream_session_partials(spark, sf):
    return _partials(spark, sf).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "session_id", "emotion", "n", "n_confidence",
        F.round("sum_confidence", 4).alias("sum_confidence"), "n_uncertain",
    )


@query
def stream_session_totals(spark, sf):
    """Live session analytics: all days of the stream, the open one included, added up."""
    return jobs.merge_partials(_partials(spark, sf))


@query
def stream_once_per_message(spark, sf):
    """Every event arrives twice and is stored once."""
    rows = _events_stream(spark, sf)
    return _run(jobs.once_per_message(rows.unionByName(rows), key="event_id").select("event_id", "session_id"), "once")


@query
def stream_append_new(spark, sf):
    """The events arrive in two batches, the second one all repeats, and are stored once."""
    path, state = scratch_path(spark, "new"), scratch_path(spark, "new-state")
    source = scratch_path(spark, "arrivals")
    rows = D.log(spark, sf).select("event_id", "session_id")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        jobs.append_new(jobs.read_stream(spark, source, rows.schema), path, state, "event_id").awaitTermination()
    return spark.read.parquet(path).select(*rows.columns)


@query
def stream_session_transitions(spark, sf):
    """Transitions of live sessions, seams between days included."""
    path = scratch_path(spark, "moves")
    jobs.transitions_table(_events_stream(spark, sf), path, scratch_path(spark, "moves-state")).awaitTermination()
    return jobs.live_transitions(spark, path)


# --- Storage ---------------------------------------------------------------------------------

@query
def split_round_trip(spark, sf):
    path = scratch_path(spark, "sides")
    tables.write_split(split.row_split(D.corpus_clean(spark, sf)).select("doc_id", "label", "split"), path)
    sides = tables.read_table(spark, path, "doc_id long, label string, split string")
    return sides.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def log_round_trip(spark, sf):
    path = scratch_path(spark, "log")
    rows = D.log(spark, sf).select(
        "session_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("input_length"),
        F.col("similarity").alias("faq_similarity_score"), F.col("emotion").alias("predicted_emotion"),
        F.col("confidence").alias("classifier_confidence"), "response_type", "latency_seconds",
    )
    for kind in ("fallback", "faq_match", "classifier_generated", "validation_error"):
        tables.append_log(rows.where(F.col("response_type") == kind), path)
    stored = tables.read_table(spark, path, tables.LOG)
    return stored.withColumn("timestamp", shown("timestamp"))


@query
def feedback_round_trip(spark, sf):
    path = scratch_path(spark, "feedback")
    votes = messages.feedback_accept(D.feedback(spark, sf), D.msgs(spark, sf))
    tables.append_feedback(votes.withColumn("timestamp", F.lit(CLOCK).cast("timestamp")), path)
    return tables.read_table(spark, path, tables.FEEDBACK).select("message_id", "helpful", shown("timestamp"))


def _message_table(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "messages")
    scored = messages.score_messages(D.msgs(spark, sf), candidates=["candidate_reply"])
    tables.append_messages(messages.stored_messages(scored, "v1", F.lit(0.0)), path)
    return path


@query
def delete_session_rewrite(spark, sf):
    """The message table after one session's deletion in place; the count of deleted rows stands in every row."""
    path = _message_table(spark, sf)
    gone = tables.delete_where(spark, path, F.col("session_id") == SESSION_SHOWN, tables.MESSAGES)
    rows = tables.read_table(spark, path, tables.MESSAGES)
    return rows.select("message_id", "session_id", F.lit(gone).cast("long").alias("deleted_messages"))


@query
def retention_rewrite(spark, sf):
    """The message table after old days and rows were dropped in place, with the count of deleted rows."""
    path = _message_table(spark, sf)
    gone = tables.drop_days_before(spark, path, datetime(2024, 1, 1, 8), tables.MESSAGES)
    rows = tables.read_table(spark, path, tables.MESSAGES)
    return rows.select("message_id", F.lit(gone).cast("long").alias("deleted_messages"))


@query
def metrics_round_trip(spark, sf):
    """The threshold choice stored as a document, and the threshold read back from it by the router."""
    path = scratch_path(spark, "choice")
    chosen = threshold_choice(spark, sf).select(
        F.create_map(F.lit("tfidf"), F.struct("threshold")).alias("chosen_thresholds")
    )
    tables.write_document(chosen, path)
    asked, stored = _sides(spark, sf)
    threshold = tables.chosen_threshold(spark, path, "tfidf")
    found = similarity.best_match(similarity.tfidf_best(asked, stored), stored, threshold)
    return found.select("query_id", "matched", F.lit(threshold).alias("threshold"))
