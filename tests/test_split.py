import hashlib
import math
from collections import Counter, defaultdict

import pytest

from colloquy.operators import frames
from colloquy.operators import split as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    # A third of the rows are copies of one text.
    rows = [(i, "Copied text!" if i % 3 == 0 else f"text number {i // 2}", "a" if i % 3 == 0 else "bc"[(i // 2) % 2]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def test_hash_rank_equals_row_number(spark):
    rows = [(i, "x" if i % 5 else None, hashlib.md5(str(i).encode()).hexdigest()) for i in range(6000)]
    got = frames.hash_rank(spark.createDataFrame(rows, "i long, s string, h string"), "s", "h").collect()
    for stratum in ("x", None):
        order = sorted(r.h for r in got if r.s == stratum)
        assert all(order[r.rank - 1] == r.h for r in got if r.s == stratum)
    assert len(got) == 6000


def test_group_split_invariants(corpus):
    out = S.group_split(corpus)
    rows = out.collect()
    assert len(rows) == 900
    sides = defaultdict(set)
    for r in rows:
        sides[r.text].add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert S.split_overlap(out).count() == 0
    groups = {r.text_key: (r.group_label, 0) for r in S.text_groups(corpus).collect()}
    held = {r.text_key for r in rows if r.split == "evaluation"}
    sizes, taken = Counter(g[0] for g in groups.values()), Counter(groups[k][0] for k in held)
    assert all(taken[label] == math.ceil(0.2 * n) for label, n in sizes.items())
    again = {r.doc_id: r.split for r in S.group_split(corpus).collect()}
    assert again == {r.doc_id: r.split for r in rows}
    other = {r.doc_id: r.split for r in S.group_split(corpus, seed=7).collect()}
    assert other != again


def test_threshold_split_keeps_copies_together(corpus):
    out = S.group_split(corpus, exact=False)
    assert S.split_overlap(out).count() == 0
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_split_shares_are_close(corpus):
    rows = S.split_distribution(S.group_split(corpus.where("label <> 'a'"))).collect()
    assert all(abs(r.train_pct - r.eval_pct) < 5 for r in rows)


def test_folds_are_balanced(corpus):
    counts = Counter((r.label, r.fold) for r in S.stratified_folds(corpus).collect())
    for label in "abc":
        sizes = [counts[label, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_row_split_size(corpus):
    counts = Counter((r.label, r.split) for r in S.row_split(corpus).collect())
    for label in "abc":
        n = counts[label, "train"] + counts[label, "validation"]
        assert counts[label, "validation"] == math.ceil(0.15 * n)


def test_membership(corpus):
    out = S.group_split(corpus)
    keys = out.where("split = 'evaluation'").select("text_key").distinct()
    assert S.rows_on_side(corpus, keys).count() == out.where(F.col("split") == "evaluation").count()


def test_rows_without_text_keep_a_side(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x y", "a"), (3, None, "b"), (4, "", "a")], "doc_id long, text string, label string")
    rows = {r.doc_id: r.split for r in S.group_split(df).collect()}
    assert len(rows) == 4 and rows[1] == rows[3] == rows[4]
