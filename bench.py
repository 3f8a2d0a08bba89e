"""Headline queries, timed on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query runs once to warm up and then twice; the faster run counts. Results
are consumed in full by a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from colloquy.plans.registry import QUERIES
from colloquy.session import build_session

HEADLINE = (
    "session_summary", "session_dominant", "emotion_transitions", "log_volume", "routing_rates", "describe_log",
    "normalize_text", "duplicate_counts", "label_conflicts", "validate_corpus", "describe_lengths",
    "token_frequency", "top_tokens", "length_outliers", "box_stats",
    "group_split", "stratified_folds", "overall_metrics", "error_by_length",
    "safety_routing", "response_policy", "message_history", "feedback_accept",
    "tfidf_cosine_top1", "jaccard_top1", "char_similarity_top1", "threshold_choice", "hybrid_route", "train_nb",
)
RUNS = 2


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(min(timed(spark, name, sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
